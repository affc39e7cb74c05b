"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits over the XXH64 values of word shingles. Two link if they differ in at most two
bits. Anchors are the words of a covering code: the product of two perfect [31,26] Hamming codes
(bits 0-30 and 31-61; covering radius one each) and all values of bits 62 and 63. Fingerprints
within two bits of each other share a midpoint z within one bit of both, and z's own anchor lies within the
covering radius of z; so a fingerprint is replicated to the anchors of all words within one bit of
it - 33 anchors, all within covering radius plus threshold - and every link meets at an anchor.
Fingerprints are compared per anchor; equal ones are one row beforehand, so a group of
copies of any size costs one row. Groups of near copies spread over the 2**54 anchors; an anchor has at most
43,745 fingerprints (the words within three bits of it) and a fingerprint at most 2,080 links,
whatever the input. That is the dealt covering cut to a proven subset of its anchors: recall stays 1.

One fingerprint misses most near copies: texts with a Jaccard similarity of 0.8 of five-word shingles often differ in some ten of its
bits. ``one_of_each`` therefore takes candidates from the covering and from bands of MinHash values of the same hashes, and
links two documents only if the Jaccard similarity of their shingle sets is at least 0.8. In a band's group, members pass one by one: each is
compared, by bits of its MinHash values, with the heads of the group so far (members that were like none before them). A first pass verifies each
member's pair with the head that it is most like, a second one the other pairs of like ones that these links haven't connected. No group is held, but for its heads' 128 bytes each.

Links form components by repeated minimum hooking on both sides of each edge (large star, small
star), each round written to shared storage.

Defined results: null text counts as empty (fingerprint zero, linked like any other); a text of fewer words
than a shingle has one shingle, its whole sequence; null ids are never the smallest id of a
component (null only if all are); repeated rows are repeated results; an empty table stays empty.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import streamed
from .scratch import fresh, join_frequent, short_batches, stored
from .textbytes import utf8_list

SHINGLE = 3
SEED = 42
MOST_BITS = 2
HALF = 31
MANY = 1 << 16


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of the lowered words; of the whole sequence if there are fewer words than a shingle has."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    n, xxh = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    if n == 1:
        return np.array([xxh(b" ".join(words), SEED)], "<u8")
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[width - 1 :].tolist()
    return np.array([xxh(whole[a:b], SEED) for a, b in zip(starts.tolist(), last)], "<u8")


def majority(values: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for s in range(0, len(values), MANY):
        ones += np.unpackbits(values[s : s + MANY].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    return majority(shingle_hashes(text, width))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@F.arrow_udf(T.LongType())
def fingerprint_udf(texts: pa.Array) -> pa.Array:
    """Fingerprints as signed 64-bit numbers."""
    known: dict[bytes, int] = {}
    out = []
    for t in utf8_list(texts):
        if t not in known:
            known[t] = signed(fingerprint(t))
        out.append(known[t])
    return pa.array(out, pa.int64())


# ---- anchors -----------------------------------------------------------------------------------


def _syndromes() -> np.ndarray:
    """Hamming syndrome of every value of the low 16 and the high 15 bits of a half: XOR of the places (1-31) of its ones."""
    out = np.zeros((2, 1 << 16), np.uint8)
    for part, base in ((0, 0), (1, 16)):
        for bit in range(16):
            out[part] ^= np.where((np.arange(1 << 16) >> bit) & 1, np.uint8((base + bit + 1) & 31), np.uint8(0))
    return out


SYNDROMES = _syndromes()


def nearest_codeword(half: np.ndarray) -> np.ndarray:
    """The codeword of the [31,26] Hamming code within one bit of each 31-bit value."""
    s = (SYNDROMES[0][half & 0xFFFF] ^ SYNDROMES[1][half >> 16]).astype(np.int64)
    return half ^ np.where(s > 0, np.int64(1) << np.maximum(s - 1, 0), 0)


def anchor_of(words: np.ndarray) -> np.ndarray:
    """The nearest codeword of the product code for each 64-bit word (as int64)."""
    mask = np.int64((1 << HALF) - 1)
    low = nearest_codeword(words & mask)
    high = nearest_codeword((words >> np.int64(HALF)) & mask)
    top = words & np.int64(-(1 << 62))
    return low | (high << np.int64(HALF)) | top


FLIPS = np.array([0, *(signed(1 << b) for b in range(64))], np.int64)


def anchors_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, how many of them) for each fingerprint: those of all words within one bit of it."""
    every = np.sort(anchor_of((prints[:, None] ^ FLIPS[None, :]).reshape(-1)).reshape(-1, len(FLIPS)), 1)
    first = np.ones(every.shape, bool)
    first[:, 1:] = every[:, 1:] != every[:, :-1]
    return every[first], first.sum(1)


def replicated(prints: DataFrame) -> DataFrame:
    """(anchor, fp) for every distinct fingerprint and each of its anchors."""

    def replicate(batches):
        for batch in batches:
            values = batch.column(0).to_numpy()
            for s in range(0, len(values), 4096):
                part = values[s : s + 4096]
                anchors, sizes = anchors_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(np.repeat(part, sizes))], names=["anchor", "fp"])

    return prints.mapInArrow(replicate, "anchor long, fp long")


def links(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints within ``most_bits`` (at most two) bits."""
    if not 0 <= most_bits <= 2:
        raise ValueError("this covering holds for thresholds of 0 to 2 bits")
    rows = replicated(prints)
    left, right = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits)
    return left.hint("merge").join(right, "anchor").where(near).select("a", "b").distinct()


def spanning_links(prints: np.ndarray, nodes: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Pairs of nodes that connect what links of ``prints`` (unsigned) connect, one less than the nodes of each component."""
    left, out = np.arange(len(prints)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for i in front:
                near = np.bitwise_count(prints[left] ^ prints[i]) <= most_bits
                out += [(int(nodes[i]), int(nodes[j])) for j in left[near]]
                reached.append(left[near])
                left = left[~near]
            front = np.concatenate(reached)
    return out


def connections(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): links that connect all nodes with some fingerprint within ``most_bits`` (at most two) bits.

    ``prints`` has (node, fps), an array of fingerprints of equal length. Rows (number, anchor, fp, node) are shuffled once, by anchor; an
    anchor's are compared where they arrive, and only a spanning forest of its links goes on, so groups of near
    copies bring no more links than rows. An anchor has at most 43,745 distinct fingerprints of a number; nodes
    that share one are linked in a chain.
    """
    if not 0 <= most_bits <= 2:
        raise ValueError("this covering holds for thresholds of 0 to 2 bits")

    def replicate(batches):
        for batch in batches:
            width = len(batch.column("fps")[0]) if batch.num_rows else 1
            nodes, values = batch.column("node").to_numpy(), batch.column("fps").flatten().to_numpy().reshape(-1, width)
            for s in range(0, len(nodes), 4096):
                for k in range(width):
                    part = np.ascontiguousarray(values[s : s + 4096, k])
                    anchors, sizes = anchors_of(part)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(anchors), k, np.int8)), pa.array(anchors), pa.array(np.repeat(part, sizes)), pa.array(np.repeat(nodes[s : s + 4096], sizes))], names=["k", "anchor", "fp", "node"])

    def compare(batches):
        held: list[list[np.ndarray]] = [[], [], [], []]

        def linked(k, anchor, fp, node):
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            again = (k[1:] == k[:-1]) & (anchor[1:] == anchor[:-1])
            same = again & (fp[1:] == fp[:-1])
            a.append(node[:-1][same])
            b.append(node[1:][same])
            first = np.r_[True, ~same]
            k, anchor, fp, node = k[first], anchor[first], fp[first].view(np.uint64), node[first]
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (anchor[1:] != anchor[:-1])])
            sizes = np.diff(np.r_[starts, len(k)])
            two = starts[sizes == 2]
            near = np.bitwise_count(fp[two] ^ fp[np.minimum(two + 1, len(fp) - 1)]) <= most_bits
            a.append(node[two[near]])
            b.append(node[two[near] + 1])
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                found = np.array(spanning_links(fp[s : s + n], node[s : s + n], most_bits), np.int64).reshape(-1, 2)
                a.append(found[:, 0])
                b.append(found[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(4)]
            if not len(new[0]):
                continue
            for h, x in zip(held, new):
                h.append(x)
            # sorted: all rows before the last anchor's are complete
            if (held[0][0][0], held[1][0][0]) != (new[0][-1], new[1][-1]):
                whole = [np.concatenate(h) for h in held]
                cut = int(np.flatnonzero((whole[0] != new[0][-1]) | (whole[1] != new[1][-1]))[-1]) + 1
                yield linked(*(x[:cut] for x in whole))
                held = [[x[cut:]] for x in whole]
        if held[0]:
            yield linked(*(np.concatenate(h) for h in held))

    rows = prints.select("node", "fps").mapInArrow(replicate, "k byte, anchor long, fp long, node long")
    return rows.repartition("k", "anchor").sortWithinPartitions("k", "anchor", "fp").mapInArrow(compare, "a long, b long")


# ---- components --------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for the nodes of an edge table (a, b)."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of u hooks to the least neighbour of u (u included)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: the smaller neighbours of u and u itself hook to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        hooked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(hooked.where("u != v").distinct(), "cc")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def rooted(documents: DataFrame, key: str, text: str, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every document; (fp, n, root, component_id) of every fingerprint (n: its documents)."""
    prints = stored(short_batches(documents).select(F.col(key).alias("doc_id"), fingerprint_udf(F.col(text)).alias("fp")), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    found = components(connections(distinct.select(F.col("fp").alias("node"), F.array("fp").alias("fps")), most_bits))
    grouped = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, stored(grouped.select("fp", "n", "root").join(smallest, "root"), "simhash-groups")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints, groups = rooted(documents, key, text, most_bits)
    joined = join_frequent(prints, groups.select("fp", "n", "component_id"), "fp", "n")
    return joined.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def row_hashes(rows: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns; a null counts as a value of its own, a map as its sorted entries."""

    def plain(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.MapType):
            return F.to_json(F.array_sort(F.map_entries(c)))
        return F.to_json(c) if isinstance(kind, (T.ArrayType, T.StructType)) else c

    values = [plain(rows[f"`{f.name}`"], f.dataType) for f in rows.schema]
    nulls = [rows[f"`{c}`"].isNull() for c in rows.columns]
    return [F.xxhash64(F.lit(salt), *values, *nulls) for salt in ("first", "second")]


# ---- near copies, verified -----------------------------------------------------------------------

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 8
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNATURE = 1024  # MinHash values (a bit of each) that members of a band's group are compared by
SIGNS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LIKE, SAME = 0.87, (1 + SIMILARITY) / 2  # share of equal bits from which a pair is verified, and its mean at a similarity of 0.8; its deviation there is 0.0094
READERS = 256  # partners that a copy of a shingle set serves


def minhashes(values: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` MinHash values (32 bits) of distinct hashes."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint64)
    for s in range(0, len(values), 512):
        least = np.minimum(least, (np.multiply.outer(FACTORS, values[s : s + 512]) >> np.uint64(32)).min(1))
    return least.astype("<u4")


def signature(members: np.ndarray) -> bytes:
    """A bit of each of ``SIGNATURE`` MinHash values of a shingle set: two sets differ in half as many as their similarity lacks of 1."""
    values = members.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    least = np.full(SIGNATURE, 0xFFFFFFFF, np.uint64)
    for s in range(0, len(values), 128):
        least = np.minimum(least, (np.multiply.outer(SIGNS, values[s : s + 128]) >> np.uint64(32)).min(1))
    return np.packbits((least & np.uint64(1)).astype(bool)).tobytes()


@F.arrow_udf(T.BinaryType())
def signature_udf(members: pa.Array) -> pa.Array:
    return pa.array([signature(np.frombuffer(m.as_py(), "<u4")) for m in members], pa.binary())


def sketch(text: bytes) -> tuple[int, list[int], int, bytes]:
    """(fingerprint, band values, what equal texts have in common, sorted shingle set of 32-bit hashes), all of five-word shingles."""
    values = shingle_hashes(text, WIDTH)
    distinct = np.unique(values)
    least, fp = minhashes(distinct), signed(majority(values))
    bands = [signed(xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i)) for i in range(BANDS)]
    members = np.unique((distinct >> np.uint64(32)).astype("<u4"))
    same = signed(xxhash.xxh64_intdigest(least.tobytes() + members.size.to_bytes(8, "little") + fp.to_bytes(8, "little", signed=True), SEED))
    return fp, bands, same, members.tobytes()


@F.arrow_udf(T.StructType().add("fp", T.LongType()).add("bands", T.ArrayType(T.LongType())).add("same", T.LongType()).add("members", T.BinaryType()))
def sketch_udf(texts: pa.Array) -> pa.Array:
    known: dict[bytes, tuple] = {}
    out = []
    for t in utf8_list(texts):
        if t not in known:
            known[t] = sketch(t)
        out.append(known[t])
    kinds = [("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("same", pa.int64()), ("members", pa.binary())]
    columns = list(zip(*out)) if out else [()] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])


@F.arrow_udf(T.DoubleType())
def jaccard_udf(left: pa.Array, right: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(left, right):
        a, b = np.frombuffer(a.as_py(), "<u4"), np.frombuffer(b.as_py(), "<u4")
        both = len(np.intersect1d(a, b, assume_unique=True))
        out.append(both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0)
    return pa.array(out, pa.float64())


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, jaccard) of pairs of nodes; ``sets`` has (node, members). A node in many pairs as ``a`` is read from several copies of its set."""
    copies = F.floor((F.col("n") - 1) / READERS).cast("long") + 1
    counts = stored(pairs.groupBy("a").agg(F.count("*").alias("n")), "near-counts")
    spread = join_frequent(pairs.withColumnRenamed("a", "key"), counts.withColumnRenamed("a", "key").withColumn("copies", copies), "key", "n").select(F.col("key").alias("a"), "b", F.pmod(F.xxhash64("b"), "copies").alias("copy"))
    left = sets.join(counts, sets["node"] == counts["a"]).select("a", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"), F.col("members").alias("_left"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("_right"))
    return short_batches(spread.join(left, ["a", "copy"]).join(right, "b")).select("a", "b", jaccard_udf("_left", "_right").alias("jaccard"))


def leaders(group):
    """(a, b) of a band's members, one by one: each with the heads that its signature is like; a member that is as like to none as similar ones are becomes a head.

    Rows without ``root`` (their component so far) meet only the head that they are most like, rows with it all such heads of other components.
    """
    heads, roots, nodes, n = np.zeros((16, SIGNATURE // 64), np.uint64), np.zeros(16, np.int64), [], 0
    for r in group:
        own, root = np.frombuffer(r["signature"], np.uint64), r.get("root")
        share = 1 - np.bitwise_count(heads[:n] ^ own).sum(1) / SIGNATURE
        like = share >= LIKE
        for i in np.flatnonzero(like & (roots[:n] != root)) if root is not None else [np.argmax(share)] if like.any() else []:
            yield {"a": min(nodes[i], r["node"]), "b": max(nodes[i], r["node"])}
        if not n or share.max() < SAME:
            if n == len(heads):
                heads, roots = np.concatenate([heads, np.zeros_like(heads)]), np.concatenate([roots, np.zeros_like(roots)])
            heads[n], roots[n] = own, root or 0
            nodes.append(r["node"])
            n += 1


def verified_links(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links that connect what similar nodes connect, as far as the covering or a band brings them together.

    ``nodes`` has (node, fp, bands, members); a node may have several equal rows. First each member of a band's group meets the head that it
    is most like, then, in groups that aren't connected yet, all heads of other components that it is like: pairs inside a component would be verified for nothing.
    """
    bands = nodes.select("node", F.explode("bands").alias("key"))
    several = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    shared = stored(several.select("key", "n"), "near-keys")
    met = stored(join_frequent(bands, shared, "key", "n").distinct(), "near-bands")
    covered = connections(nodes.select("node", "fp").distinct().select("node", F.array("fp").alias("fps")))
    close = stored(covered.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "near-prints")
    needed = stored(met.select("node").union(close.select("a")).union(close.select("b")).distinct(), "near-nodes")
    members = nodes.select("node", "members").join(needed, "node", "left_semi").groupBy("node").agg(F.first("members").alias("members"))
    sets = stored(short_batches(members).withColumn("signature", signature_udf("members")), "near-sets")

    def linked(rows: DataFrame, *more: DataFrame) -> DataFrame:
        signed_rows = rows.join(sets.select("node", "signature"), "node").withColumn("place", F.xxhash64("node"))  # one order for all bands: a copy meets the same heads in most of them
        found = streamed(signed_rows, ["key"], ["place", "node"], leaders, "a long, b long")
        pairs = stored(functools.reduce(DataFrame.union, more, found).where("a < b").distinct(), "near-pairs")
        return stored(similar(pairs, sets).where(F.col("jaccard") >= similarity).select("a", "b"), "near-links")

    roots = stored(components(linked(met, close)), "near-roots")
    rooted = stored(met.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-rooted")
    apart = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    return roots.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a < b").union(linked(rooted.join(apart, "key", "left_semi")))


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near copies: of each component one row, that with the smallest id.

    Documents link if the Jaccard similarity of their sets of five-word shingles (32-bit hashes) is at least ``similarity``; texts with equal
    MinHash values, set size and fingerprint count as equal. Ids may repeat or be null (null is
    after all others): of rows that share the smallest id, the one with the least hash of all columns stays,
    and of rows equal in every column one. All columns, maps too, are returned as they were. A row is known by 128
    bits of hash. Whole rows are shuffled once, by that hash; equal rows are one before that.
    """
    h1, h2 = fresh(documents, 2)
    first, second = row_hashes(documents)
    prints = short_batches(documents).select(F.col(key).alias("doc_id"), sketch_udf(F.col(text)).alias("s"), first.alias("h1"), second.alias("h2"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("least")
    texts = stored(prints.select("doc_id", "h1", "h2", F.col("s.same").alias("node"), "s.fp", "s.bands", "s.members"), "simhash-texts")
    nodes = stored(texts.groupBy("node").agg(least), "simhash-distinct")
    found = components(verified_links(texts.select("node", "fp", "bands", "members"), similarity))
    rooted_rows = nodes.select("node", "least").join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
    keep = rooted_rows.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.h1").alias(h1), F.col("least.h2").alias(h2))
    rows = documents.withColumns({h1: first, h2: second}).dropDuplicates([h1, h2])
    return rows.join(keep.hint("merge"), [h1, h2], "left_semi").select(*(f"`{c}`" for c in documents.columns))

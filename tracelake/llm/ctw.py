"""Language-model scores by context-tree weighting over bytes.

The text of a document is its lowered words joined by one blank and closed by a line feed (its end
token). Every byte is coded as eight binary decisions; each decision has a context tree over the
preceding bytes. A node's Krichevsky-Trofimov (KT) estimate is mixed with its children's weighted
probability, half and half, at every depth; the frozen mixture gives each byte's code length.

Training is a Spark aggregation of all (context, byte) counts of all training documents, and every
counted context is a node, so the model grows with the text. A *gram* is a context of full depth
and its byte. Grams that only held-out documents have are listed with a count of 0, so the table of
grams has a probability for whatever is scored:

1. The grams are dealt by the last ``SPLIT`` bytes of their contexts, so that a task has whole
   subtrees. It weights them from the leaves upward, and folds each gram's forecast down to there.
2. The levels above (at most 256 contexts) are sums over the subtrees; the driver weights them.
3. Each gram's forecast is folded through those levels: that is the table (gram, log2 P).

The most counted grams, at most ``FREQUENT_GRAMS``, are a stored table that each worker reads, so they are resolved where the documents are read; a
document's other grams are joined with their counts to the table, as its rare words are.

With ``spread`` the model is bounded instead: a context longer than one byte becomes a node only if
it holds at least 1 / ``spread`` of all bytes, and what falls outside a node's kept children goes to
one further child ("rest"). No query uses that.

Word counts for the unigram base are exact. Words holding at least 1 / ``frequent`` of all tokens
(at most ``frequent`` words) are resolved where the documents are read; all others are joined to
the count table by word, where no word can be frequent.

Defined results: null text counts as empty (one token, the end); a null id is a training document;
repeated rows are scored each; without training documents all counts are 0; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import new_path, short_batches, store_address, store_of, stored
from .textbytes import chunks, utf8_list

DEPTH = 5
SPLIT = 2
FREQUENT = 20000
FREQUENT_GRAMS = 1 << 20
SUBTREE_ROWS = 1 << 20
CHUNK_BYTES = 2 << 20
END = b"\n"
LOG10_2 = float(np.log10(2.0))


def held_out(key: Column, parts: int = 7, part: int = 2) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``part``."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    """Lowered words; bytes.lower and bytes.split touch exactly A-Z and 0x20, 0x09-0x0D."""
    return text.lower().split()


def coded_positions(words: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with ``depth`` line feeds before each text, indexes of coded bytes, coded bytes of each text)."""
    texts = [b" ".join(w) + END for w in words]
    raw = np.frombuffer(b"".join(END * depth + t for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    skip = np.repeat(np.arange(1, len(texts) + 1) * depth, sizes)
    return raw, np.arange(len(skip)) + skip, sizes


def gram_keys(raw: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` bytes before and the byte itself, as one integer (the byte is lowest)."""
    key = raw[at].astype(np.uint64)
    for d in range(1, depth + 1):
        key |= raw[at - d].astype(np.uint64) << np.uint64(8 * d)
    return key


# ---- training ----------------------------------------------------------------------------------


def training_counts(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(word, gram, n): counts of words (the end is '') and of (context, byte), over all rows of a text column.

    With a second, Boolean column, rows where it holds count as 0 and bring no words, only their grams.
    """

    def count(batches):
        words: Counter = Counter()
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            nonlocal keys, sums
            every = np.concatenate([keys, *(k for k, _ in held)])
            n = np.concatenate([sums, *(c for _, c in held)])
            order = np.argsort(every, kind="stable")
            every, n = every[order], n[order]
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
            keys, sums = every[first], np.add.reduceat(n, first) if len(first) else n
            held.clear()

        def put(words_now: dict, k: np.ndarray, c: np.ndarray):
            n_words = len(words_now)
            w = pa.array([*words_now, *[None] * len(k)], pa.binary()).cast(pa.string())
            g = pa.concat_arrays([pa.nulls(n_words, pa.int64()), pa.array(k.astype(np.int64))])
            n = pa.concat_arrays([pa.array(list(words_now.values()), pa.int64()), pa.array(c.astype(np.int64))])
            return pa.RecordBatch.from_arrays([w, g, n], names=["word", "gram", "n"])

        for batch in batches:
            raws = utf8_list(batch.column(0))
            for a, b in chunks(np.array([len(x) for x in raws], np.int64), CHUNK_BYTES):
                rows = [words_of(x) for x in raws[a:b]]
                silent = np.array(batch.column(1)[a:b].to_pylist(), bool) if batch.num_columns > 1 else np.zeros(len(rows), bool)
                for r in itertools.compress(rows, ~silent):
                    words.update(r)
                    words[b""] += 1
                for only in (~silent, silent):
                    if only.any():
                        raw, at, _ = coded_positions(list(itertools.compress(rows, only)), depth)
                        k, c = np.unique(gram_keys(raw, at, depth), return_counts=True)
                        held.append((k, np.where(only is silent, 0, c)))
                if sum(len(k) for k, _ in held) > 1_000_000:
                    merge()
                if len(words) > 500_000 or len(keys) > 2_000_000:
                    merge()
                    yield put(words, keys, sums)
                    words, keys, sums = Counter(), keys[:0], sums[:0]
        merge()
        yield put(words, keys, sums)

    return texts.mapInArrow(count, "word string, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def kept_counts(grams: DataFrame, depth: int, spread: int) -> DataFrame:
    """(depth, context, byte, n) of the contexts that become nodes; depth 0 is the root."""
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    deep = grams.select("n", (F.col("gram").bitwiseAND(255)).cast("int").alias("byte"), F.shiftright("gram", 8).alias("all"), F.explode(F.array(*[F.lit(d) for d in range(depth + 1)])).alias("depth"))
    masks = F.create_map(*[x for d in range(depth + 1) for x in (F.lit(d), F.lit((1 << (8 * d)) - 1).cast("bigint"))])
    deep = deep.select("n", "byte", "depth", F.col("all").bitwiseAND(masks[F.col("depth")]).alias("context"))
    by_byte = deep.groupBy("depth", "context", "byte").agg(F.sum("n").alias("n"))
    nodes = deep.groupBy("depth", "context").agg(F.sum("n").alias("all")).where((F.col("depth") <= 1) | (F.col("all") * spread >= total)).drop("all")
    return by_byte.join(nodes, ["depth", "context"], "left_semi")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5, by Stirling's series eight steps up."""
    y = x + 8.0
    product = np.ones_like(x)
    for i in range(8):
        product = product * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the KT probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - 2 * log_gamma(np.array(0.5))


def binary_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the 255 binary decisions of a byte, highest bit first, from counts of 256 bytes."""
    zeros, ones = [], []
    for level in range(8):
        halves = counts.reshape(len(counts), 2 << level, -1).sum(-1)
        zeros.append(halves[:, 0::2])
        ones.append(halves[:, 1::2])
    return np.concatenate(zeros, 1), np.concatenate(ones, 1)


class ContextTree:
    """The frozen mixture: ``child[node, byte]`` walks back through the context, ``bits[leaf, byte]`` is log2 P."""

    def __init__(self, table, depth: int = DEPTH):
        """``table``: pandas frame (depth, context, byte, n) with the kept nodes."""
        nodes = table[["depth", "context"]].drop_duplicates().sort_values(["depth", "context"]).to_numpy()
        where = {(int(d), int(c)): i for i, (d, c) in enumerate(nodes)}
        if (0, 0) not in where:
            where = {(0, 0): 0}
            nodes = np.zeros((1, 2), np.int64)
        n = len(nodes)
        counts = np.zeros((n, 256))
        if len(table):
            key = {k: i for k, i in where.items()}
            ids = np.array([key[int(d), int(c)] for d, c in zip(table["depth"], table["context"])])
            counts[ids, table["byte"].to_numpy()] = table["n"].to_numpy()
        level = nodes[:, 0].astype(np.int64)
        parent = np.full(n, -1, np.int64)
        last = np.zeros(n, np.int64)
        for i in range(1, n):
            d, c = int(nodes[i, 0]), int(nodes[i, 1])
            parent[i], last[i] = where[d - 1, c & ((1 << (8 * (d - 1))) - 1)], c >> (8 * (d - 1))
        inner = np.unique(parent[parent >= 0])
        rest = counts[inner].copy()
        row = np.full(n, -1, np.int64)
        row[inner] = np.arange(len(inner))
        np.subtract.at(rest, row[parent[1:]], counts[1:])
        counts = np.concatenate([counts, rest])
        level = np.concatenate([level, level[inner] + 1])
        parent = np.concatenate([parent, inner])
        total = len(counts)
        zeros, ones = binary_counts(counts)
        kt = log_kt(zeros, ones)
        weighted = kt.copy()
        own = np.ones_like(kt)
        below = np.zeros_like(kt)
        for d in range(depth, 0, -1):
            here = np.flatnonzero(level == d)
            np.add.at(below, parent[here], weighted[here])
            up = inner[level[inner] == d - 1]
            a, b = kt[up] + np.log(0.5), below[up] + np.log(0.5)
            weighted[up] = np.logaddexp(a, b)
            own[up] = np.exp(a - weighted[up])
        zero = (zeros + 0.5) / (zeros + ones + 1.0)
        mixed = zero.copy()
        # forecast of a leaf seen from the root: fold own estimates from the deepest node upward
        for leaf_level in range(1, depth + 1):
            leaf = np.flatnonzero((level == leaf_level) & ~np.isin(np.arange(total), inner))
            if not len(leaf):
                continue
            p, at = zero[leaf], parent[leaf]
            for _ in range(leaf_level):
                w = own[at]
                p = w * zero[at] + (1.0 - w) * p
                at = parent[at]
            mixed[leaf] = p
        bits = np.zeros((total, 256), np.float32)
        value = np.arange(256)
        for k in range(8):
            p0 = mixed[:, (1 << k) - 1 + (value >> (8 - k))]
            bits += np.log2(np.where((value >> (7 - k)) & 1, 1.0 - p0, p0)).astype(np.float32)
        child = np.repeat(np.arange(total, dtype=np.int32)[:, None], 256, 1)
        child[inner] = (n + row[inner]).astype(np.int32)[:, None]
        child[parent[1:n], last[1:n]] = np.arange(1, n, dtype=np.int32)
        self.bits, self.child, self.depth = bits, child, depth

    def log2_probability(self, words: list[list[bytes]]) -> np.ndarray:
        """log2 P of each text (its words and its end)."""
        raw, at, sizes = coded_positions(words, self.depth)
        state = np.zeros(len(at), np.int32)
        for d in range(1, self.depth + 1):
            state = self.child[state, raw[at - d]]
        return np.add.reduceat(self.bits[state, raw[at]].astype(np.float64), np.cumsum(sizes) - sizes)


# ---- the whole tree ----------------------------------------------------------------------------


class Level:
    """One depth of a set of subtrees: its (context, byte) entries, sorted, and its binary decisions."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        """``keys``: context (its last byte highest), then the byte; ascending."""
        self.keys, self.spot, self.first, self.zeros, self.ones, self.kt, self.taken = keys, [], [], [], [], [], []
        for k in range(8):
            prefix = keys >> np.uint64(8 - k)
            first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
            spot = np.cumsum(np.r_[False, prefix[1:] != prefix[:-1]])
            bit = ((keys >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
            both, ones = np.add.reduceat(n, first), np.add.reduceat(n * bit, first)
            chosen = np.where(bit == 1, ones[spot], (both - ones)[spot])
            self.spot.append(spot)
            self.first.append(first)
            self.zeros.append(both - ones)
            self.ones.append(ones)
            self.kt.append(log_kt((both - ones).astype(float), ones.astype(float)))
            self.taken.append((chosen + 0.5) / (both[spot] + 1.0))


def weigh_subtrees(grams: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Whole subtrees of the contexts of ``SPLIT`` bytes, from their distinct grams and counts.

    Returns (order of the grams, forecasts of the eight bits of each gram at the subtree's root,
    decisions of the level above with the sums of their children (key, ln weighted, zeros, ones)).
    """
    split = min(SPLIT, depth)
    turned = np.zeros(len(grams), np.uint64)
    for d in range(depth):
        turned |= ((grams >> np.uint64(8 * (d + 1))) & np.uint64(255)) << np.uint64(8 * (depth - d))
    turned |= grams & np.uint64(255)
    order = np.argsort(turned, kind="stable")
    keys, n = turned[order], n[order]
    levels, ups = [Level(keys, n)], []
    for _ in range(depth - split):
        keys, up = np.unique((keys >> np.uint64(16) << np.uint64(8)) | (keys & np.uint64(255)), return_inverse=True)
        n = np.bincount(up, n, len(keys)).astype(np.int64)
        levels.append(Level(keys, n))
        ups.append(up)
    half = np.log(0.5)
    weighted, owns = levels[0].kt, []
    for i, up in enumerate(ups):
        above, own = [], []
        for k in range(8):
            kt = levels[i + 1].kt[k]
            below = np.bincount(levels[i + 1].spot[k][up[levels[i].first[k]]], weighted[k], len(kt))
            above.append(np.logaddexp(kt + half, below + half))
            own.append(np.exp(kt + half - above[k]))
        weighted = above
        owns.append(own)
    forecast = np.zeros((len(grams), 8))
    for k in range(8):
        p, entry = levels[0].taken[k], np.arange(len(grams))
        for i, up in enumerate(ups):
            entry = up[entry]
            w = owns[i][k][levels[i + 1].spot[k][entry]]
            p = w * levels[i + 1].taken[k][entry] + (1.0 - w) * p
        forecast[:, k] = p
    root = levels[-1]
    at = np.concatenate([(root.keys[f] >> np.uint64(16) << np.uint64(8) | np.uint64((1 << k) - 1) + ((root.keys[f] & np.uint64(255)) >> np.uint64(8 - k))) for k, f in enumerate(root.first)])
    node, where = np.unique(at, return_inverse=True)
    return order, forecast, (node, *(np.bincount(where, np.concatenate(x), len(node)) for x in (weighted, root.zeros, root.ones)))


_MODEL = "gram bigint, n bigint, bits binary, node bigint, below double, zeros bigint, ones bigint"


def subtree_table(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows of grams (gram, n, forecasts of its bits) and of decisions above the subtrees (node, below, zeros, ones)."""
    mask = (1 << (8 * min(SPLIT, depth))) - 1

    def weigh(batches):
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def put(keys: np.ndarray, n: np.ndarray):
            order, forecast, (node, below, zeros, ones) = weigh_subtrees(keys.astype(np.uint64), n, depth)
            a, b = len(keys), len(node)
            bits = pa.Array.from_buffers(pa.binary(64), a, [None, pa.py_buffer(np.ascontiguousarray(forecast).tobytes())]).cast(pa.binary())
            columns = [(pa.array(keys[order]), None), (pa.array(n[order]), None), (bits, None), (None, pa.array(node.astype(np.int64))), (None, pa.array(below)), (None, pa.array(zeros.astype(np.int64))), (None, pa.array(ones.astype(np.int64)))]
            whole = [pa.concat_arrays([pa.nulls(a, y.type) if x is None else x, pa.nulls(b, x.type) if y is None else y]) for x, y in columns]
            return pa.RecordBatch.from_arrays(whole, names=["gram", "n", "bits", "node", "below", "zeros", "ones"])

        held: list = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(k) for k, _ in held) >= SUBTREE_ROWS:
                keys, n = (np.concatenate(x) for x in zip(*held))
                tree = (keys >> 8) & mask
                cut = int(np.flatnonzero(tree != tree[-1])[-1]) + 1 if (tree != tree[-1]).any() else 0
                if cut:
                    yield put(keys[:cut], n[:cut])
                held = [(keys[cut:], n[cut:])]
        if held and sum(len(k) for k, _ in held):
            yield put(*(np.concatenate(x) for x in zip(*held)))

    tree = F.shiftright("gram", 8).bitwiseAND(mask)
    return grams.select("gram", "n").repartition(tree).sortWithinPartitions(tree).mapInArrow(weigh, _MODEL)


def top_levels(nodes, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """(own weight, probability of a 0) per context and decision of each level above the subtrees, lowest level first.

    ``nodes``: pandas frame (node, below, zeros, ones) of the lowest of these levels.
    """
    split = min(SPLIT, depth)
    if not split:
        return []
    shape = (256 ** (split - 1), 256)
    sums = [np.zeros(shape) for _ in range(3)]
    for table, name in zip(sums, ("below", "zeros", "ones")):
        table.reshape(-1)[nodes["node"].to_numpy(np.int64)] = nodes[name].to_numpy(float)
    below, zeros, ones = sums
    out, half = [], np.log(0.5)
    for level in range(split - 1, -1, -1):
        kt = log_kt(zeros, ones) + half
        weighted = np.logaddexp(kt, below + half)
        out.append((np.exp(kt - weighted), (zeros + 0.5) / (zeros + ones + 1.0)))
        if level:
            below, zeros, ones = (x.reshape(-1, 256, 256).sum(1) for x in (weighted, zeros, ones))
    return out


def log2_udf(top: list[tuple[np.ndarray, np.ndarray]], depth: int = DEPTH):
    """Arrow UDF: (gram, forecasts of its bits) -> log2 P of its byte."""
    split = min(SPLIT, depth)

    @F.arrow_udf("double")
    def log2_p(grams: pa.Array, bits: pa.Array) -> pa.Array:
        keys = grams.to_numpy(zero_copy_only=False).astype(np.int64)
        p = np.frombuffer(b"".join(bits.to_pylist()), np.float64).reshape(len(keys), 8)
        byte, total = keys & 255, np.zeros(len(keys))
        context = [np.zeros(len(keys), np.int64)]
        for d in range(1, split):
            context.append((context[-1] << 8) | ((keys >> (8 * d)) & 255))
        for k in range(8):
            q, at, bit = p[:, k], (1 << k) - 1 + (byte >> (8 - k)), (byte >> (7 - k)) & 1
            for (own, zero), c in zip(top, reversed(context)):
                w, z = own[c, at], zero[c, at]
                q = w * np.where(bit == 1, 1.0 - z, z) + (1.0 - w) * q
            total += np.log2(q)
        return pa.array(total)

    return log2_p


class GramTable:
    """log2 P of the most counted grams."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray, depth: int = DEPTH):
        order = np.argsort(keys)
        self.keys, self.bits, self.depth = keys[order].astype(np.uint64), bits[order].astype(np.float64), depth

    def score(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log2 P of each text without its other grams, and these grams: text, gram, count)."""
        raw, at, sizes = coded_positions(words, self.depth)
        grams = gram_keys(raw, at, self.depth)
        key, where = np.unique(grams, return_inverse=True)
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[spot] == key
            bits = np.where(known, self.bits[spot], 0.0)
        else:
            known, bits = np.zeros(len(key), bool), np.zeros(len(key))
        total = np.add.reduceat(bits[where], np.cumsum(sizes) - sizes)
        other = np.flatnonzero(~known[where])
        text = np.searchsorted(np.cumsum(sizes), other, side="right")
        pair, n = np.unique(text * len(key) + where[other], return_counts=True)
        return total, pair // max(len(key), 1), key[pair % max(len(key), 1)], n


_LOADED: dict[str, GramTable] = {}


@dataclass(frozen=True)
class StoredGrams:
    """A table of at most ``FREQUENT_GRAMS`` (gram, bits) in shared storage; a worker reads it once, the driver never."""

    path: str
    depth: int

    def table(self) -> GramTable:
        if self.path not in _LOADED:
            import pyarrow.fs as fs
            import pyarrow.parquet as pq

            store, root = store_of(self.path)
            files = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".parquet")]
            read = [pq.read_table(f, columns=["gram", "bits"], filesystem=store) for f in sorted(files)]
            columns = [np.concatenate([t[n].to_numpy() for t in read]) if read else np.zeros(0) for n in ("gram", "bits")]
            _LOADED.clear()
            _LOADED[self.path] = GramTable(columns[0].astype(np.int64), columns[1].astype(np.float64), self.depth)
        return _LOADED[self.path]


def gram_table(counts: DataFrame, depth: int, most: int) -> tuple[StoredGrams, DataFrame]:
    """(the most counted grams, at most ``most``; (gram, bits) of all others) from all grams and counts."""
    model = stored(subtree_table(counts, depth), "ctw-model")
    nodes = model.where("node is not null").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("below", "zeros", "ones"))).toPandas()
    rank = F.floor(F.log2(F.col("n") + 1) * 8).cast("int")
    grams = model.where("gram is not null").select("gram", "bits", rank.alias("rank"))
    cut, total = None, 0
    for r in sorted(grams.groupBy("rank").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        cut = r["rank"]
    log2_p = log2_udf(top_levels(nodes, depth), depth)
    often = grams.where(F.lit(False) if cut is None else F.col("rank") >= cut).select("gram", log2_p("gram", "bits").alias("bits"))
    path = new_path(counts.sparkSession, "ctw-frequent")
    store_address(path)
    often.write.parquet(path)
    others = grams.where(F.lit(True) if cut is None else F.col("rank") < cut).select("gram", log2_p("gram", "bits").alias("bits"))
    return StoredGrams(path, depth), others


# ---- scoring -----------------------------------------------------------------------------------

_SCORED = "n_tokens bigint, score double, known bigint, base double, rare array<struct<word:string,n:bigint>>, grams array<struct<gram:bigint,n:bigint>>"
_SCORED_KIND = pa.struct([("n_tokens", pa.int64()), ("score", pa.float64()), ("known", pa.int64()), ("base", pa.float64()), ("rare", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))), ("grams", pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())])))])


def scoring_udf(tree: ContextTree | StoredGrams, frequent: dict[bytes, float]):
    """Arrow UDF: text -> token count, log10 P, base terms of frequent words, the rare words, and the grams that log10 P lacks."""

    @F.arrow_udf(_SCORED)
    def score(texts: pa.Array) -> pa.Array:
        raws = utf8_list(texts)
        n_tokens, scores, known, base = [], [], [], []
        names: list[bytes] = []
        counts: list[int] = []
        ends, gram_ends = [0], [np.zeros(1, np.int64)]
        grams: list[np.ndarray] = []
        gram_counts: list[np.ndarray] = []
        for a, b in chunks(np.array([len(x) for x in raws], np.int64), CHUNK_BYTES):
            rows = [words_of(x) for x in raws[a:b]]
            if isinstance(tree, StoredGrams):
                log2, row, gram, n = tree.table().score(rows)
                grams.append(gram)
                gram_counts.append(n)
                gram_ends.append(gram_ends[-1][-1] + np.cumsum(np.bincount(row, minlength=len(rows))))
            else:
                log2 = tree.log2_probability(rows)
                gram_ends.append(np.repeat(gram_ends[-1][-1:], len(rows)))
            scores += (log2 * LOG10_2).tolist()
            for r in rows:
                n_tokens.append(len(r) + 1)
                total, seen = 0.0, 0
                r.append(b"")
                for w, c in Counter(r).items():
                    f = frequent.get(w)
                    if f is None:
                        names.append(w)
                        counts.append(c)
                    else:
                        total += c * f
                        seen += c
                known.append(seen)
                base.append(total)
                ends.append(len(names))
        pairs = pa.StructArray.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])
        rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        every = pa.StructArray.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in (grams, gram_counts)], names=["gram", "n"])
        lacking = pa.ListArray.from_arrays(pa.array(np.concatenate(gram_ends), pa.int32()), every)
        return pa.StructArray.from_arrays([pa.array(n_tokens, pa.int64()), pa.array(scores, pa.float64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), rare, lacking], fields=list(_SCORED_KIND))

    return score


def score_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, spread: int | None = None, frequent: int = FREQUENT, frequent_grams: int = FREQUENT_GRAMS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    rows = short_batches(documents).select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    counted = rows.select("text", "held_out") if spread is None else rows.where("not held_out").select("text")
    counts = stored(training_counts(counted, depth), "ctw-counts")
    words = counts.where("word is not null").select("word", F.col("n").alias("c"))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    grams, others = counts.where("gram is not null").select("gram", "n"), None
    if spread is None:
        tree, others = gram_table(grams, depth, frequent_grams)
    else:
        tree = ContextTree(kept_counts(grams, depth, spread).toPandas(), depth)
    often = {r["word"].encode(): float(np.log10(r["c"] + 1)) for r in words.where(F.col("c") * frequent >= n).collect()}
    scored = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", scoring_udf(tree, often)("text").alias("s"))
    scored = stored(scored.select("row", "doc_id", "held_out", "s.*"), "ctw-scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    terms = rare.join(words.where(F.col("c") * frequent < n), "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("also"))
    out = scored.drop("rare", "grams").join(terms, "row", "left")
    if others is not None:
        lacking = scored.select("row", F.explode("grams").alias("g")).select("row", "g.gram", "g.n").join(others, "gram")
        lacking = lacking.groupBy("row").agg(F.sum(F.col("n") * F.col("bits") * LOG10_2).alias("deep"))
        out = out.join(lacking, "row", "left").withColumn("score", F.col("score") + F.coalesce("deep", F.lit(0.0)))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(float(n + v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")

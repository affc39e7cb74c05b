"""Best-fit packing of tokenised documents into sequences.

A document is its token ids and a closing id; only what is longer than a sequence is cut. A piece
takes a vector of resources from its bin: tokens, one document, and attention cost (its length
squared). Pieces are placed by decreasing length into the feasible bin whose residual vector leaves the least
norm after placement (``rule="norm"``) or has the greatest weighted dot product with the piece
(``rule="dot"``); every constraint holds for every bin.

A piece's vector depends on its length alone, so pieces of one length are interchangeable: best-fit is run
over the histogram of lengths (at most ``capacity`` rows, however many documents there are) and over
groups of equal bins. A bin that took a piece is an even better fit for the next of that length by norm, so
it is filled at once; by dot product it is a worse one, so pieces are dealt one to each bin in turn. The result, runs of (length, number range) -> (sequence numbers, offset), is bounded the same way.
Every piece then gets its number among those of its length - counted by (length, bucket), with
many buckets to a length, also for rows equal in every column, so that one frequent length is no hot key - and looks up its place.

Defined results: null text counts as empty (the closing id alone); null ids and repeated rows are
packed like any other; an empty table gives no rows; extra columns are ignored; of bins that fit equally
well the first opened takes the piece. A text of any length is tokenised whole by one task, in memory of
some 60 times its bytes.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import short_batches, stored
from .textbytes import LOWER, chunks, span_hashes, utf8_views, words_of

CAPACITY = 4096
END_ID = 1
BUCKETS = 1024
TOKENIZER = "word_bpe_49k.json"
MOST_KNOWN = 400_000
CHUNK_BYTES = 1 << 20


# ---- tokens ------------------------------------------------------------------------------------

#: Byte classes: 1 a letter whose lower case and composed form are plain (A-Z, a-z, and À-ÿ of two bytes, see
#: ``classes_of``), 2 ASCII punctuation without the apostrophe (which may begin a contraction), 0 all else.
LETTER, PUNCTUATION = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = PUNCTUATION
KIND[[b for b in range(128) if chr(b).isalpha()]] = LETTER
LATIN, TIMES, DIVIDED = 0xC3, 0x97, 0xB7  # the first byte of U+00C0-U+00FF, and the second bytes of its two signs


def classes_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of every byte, bytes with plain letters lowered)."""
    kind, low = KIND[raw], LOWER[raw]
    second = np.flatnonzero(raw[:-1] == LATIN) + 1
    second = second[(raw[second] != TIMES) & (raw[second] != DIVIDED)]
    kind[second] = kind[second - 1] = LETTER
    low[second[raw[second] < 0x9F]] += 32
    return kind, low


class WordIds:
    """Token ids by parts of words. White space always separates this tokenizer's words, so a text's ids are those of
    its blank-separated words; a word of plain letters with punctuation after them has the ids of the
    lowered letters, then those of the punctuation. Any other word is one part as it stands.

    Parts are found, hashed (64 bits) and looked up for many texts at once; only parts never met before go
    to the tokenizer. The table of parts starts anew beyond ``MOST_KNOWN``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.array([(self.full.id_to_token(i) or "").endswith("</w>") for i in range(self.full.get_vocab_size())])
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of known parts, sorted, with the place and number of their ids
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def plain_ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part) of lowered letters and of punctuation, in one call."""
        ids = np.array(self.bare.encode_batch_fast([b" ".join(parts).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(parts) else self.other_ids(parts)

    def other_ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part) of any parts."""
        found = self.full.encode_batch_fast([x.decode("utf-8", "replace") for x in parts], add_special_tokens=False)
        return np.array([i for x in found for i in x.ids], np.uint32), np.array([len(x.ids) for x in found], np.int64)

    def learn(self, keys: np.ndarray, parts: list[bytes], plain: np.ndarray) -> None:
        """Add parts, given with their hashes (ascending)."""
        groups = [np.flatnonzero(plain)[i : i + 5000] for i in range(0, int(plain.sum()), 5000)]
        groups += [x for x in (np.flatnonzero(~plain),) if len(x)]
        starts, sizes = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        flat, used = [self.flat], len(self.flat)
        for group in groups:
            some = [parts[i] for i in group.tolist()]
            ids, n = self.plain_ids(some) if plain[group[0]] else self.other_ids(some)
            starts[group], sizes[group] = used + np.cumsum(n) - n, n
            flat.append(ids)
            used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.starts, self.sizes, self.keys = np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes), np.insert(self.keys, at, keys)
        self.flat = np.concatenate(flat)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin + their number) for texts given as bytes and offsets."""
        start, end, first = words_of(raw, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        kind, low = classes_of(raw)
        before = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        letters, odd = before(kind == LETTER), before(kind == 0)
        back = before((kind == LETTER) & np.concatenate([[False], kind[:-1] == PUNCTUATION]))  # letters after punctuation
        whole = (odd[end] > odd[start]) | (back[end] > back[start + 1])
        middle = np.where(whole, end, start + letters[end] - letters[start])
        as_is = np.zeros(len(raw) + 1, np.int64)
        np.add.at(as_is, start[whole], 1)
        np.add.at(as_is, end[whole], -1)
        low = np.where(np.cumsum(as_is[:-1]) > 0, raw, low)
        a, b = np.stack([start, middle], 1).reshape(-1), np.stack([middle, end], 1).reshape(-1)
        used = np.flatnonzero(b > a)
        a, b = a[used], b[used]
        key, sample, which = np.unique(span_hashes(low, a, b), return_index=True, return_inverse=True)
        if len(self.keys) > MOST_KNOWN:
            self.forget()
        spot = np.searchsorted(self.keys, key)
        new = np.flatnonzero(self.keys[np.minimum(spot, len(self.keys) - 1)] != key) if len(self.keys) else np.arange(len(key))
        if len(new):
            data, at = low.tobytes(), sample[new]
            self.learn(key[new], [data[x:y] for x, y in zip(a[at].tolist(), b[at].tolist())], ~whole[used[at] // 2])
            spot = np.searchsorted(self.keys, key)
        sizes = self.sizes[spot][which]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[spot][which] - ends + sizes, sizes)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(used, 2 * first)]


_TOKENIZERS: dict[str, WordIds] = {}


def tokenizer_of(path: str) -> WordIds:
    """One tokenizer with its known words per Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def pieces_udf(path: str, capacity: int = CAPACITY, end_id: int = END_ID):
    """Arrow UDF: text -> array<struct<piece, start, length, ids_crc32>>."""
    names = ["piece", "start", "length", "ids_crc32"]

    @F.arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")
    def cut(texts: pa.Array) -> pa.Array:
        words = tokenizer_of(path)
        raw, off = utf8_views(texts)
        rows: list[tuple[int, int, int, int]] = []
        ends = [0]
        for a, b in chunks(np.diff(off), CHUNK_BYTES):
            every, at = words.encode(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                ids = np.append(every[s:e], np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((k, start, len(part), zlib.crc32(part.tobytes())))
                ends.append(len(rows))
        columns = np.array(rows, np.int64).reshape(-1, 4).T
        pieces = pa.StructArray.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns)], names=names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces)

    return cut


# ---- best fit over the histogram ---------------------------------------------------------------


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds: tokens, documents, and attention cost (sum of squared lengths)."""

    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"


def best_fit(histogram: dict[int, int], limits: Capacities = Capacities()) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first number, count, first sequence, pieces of this length per sequence, offset).

    Number r of a run, counted from its first, goes to sequence first + r // per at offset +
    (r % per) * length. Equal bins are kept as one group (residual vector, first sequence, count).
    """
    full = np.array([limits.tokens, limits.documents, limits.attention], np.int64)
    weights = np.array(limits.weights) / full
    groups = np.zeros((0, 6), np.int64)  # tokens left, documents left, attention left, offset, first sequence, bins
    runs: list[tuple[int, int, int, int, int, int]] = []
    fresh = 0
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds an empty sequence")
        left, number = int(histogram[length]), 0
        made: list[list[int]] = []

        def fill(g: list[int], bins: int, per: int) -> list[int]:
            """Put ``per`` pieces into each of the first ``bins`` bins of a group, which become a group of their own."""
            nonlocal left, number
            runs.append((length, number, bins * per, g[4], per, g[3]))
            number += bins * per
            left -= bins * per
            done = [g[0] - per * length, g[1] - per, g[2] - per * length * length, g[3] + per * length, g[4], bins]
            g[4] += bins
            g[5] -= bins
            return done

        def room(g: list[int]) -> int:
            return min(int(g[i] // need[i]) for i in range(3))

        if limits.rule == "norm":
            feasible = np.flatnonzero((groups[:, :3] >= need).all(1))
            worth = np.sqrt((((groups[feasible, :3] - need) * weights) ** 2).sum(1))
            for at in feasible[np.lexsort((groups[feasible, 4], worth))].tolist():
                if not left:
                    break
                g = groups[at].tolist()
                fits = room(g)
                if bins := min(g[5], left // fits):
                    made.append(fill(g, bins, fits))
                if g[5] and left:
                    made.append(fill(g, 1, left))
                groups[at] = g
        else:
            dot = lambda g: float(((np.array(g[:3]) * weights) * (need * weights)).sum())
            heap = [(-dot(g), g[4], g) for g in groups.tolist() if room(g)]
            heapq.heapify(heap)
            groups = groups[(groups[:, :3] < need).any(1)]
            while heap and left:
                _, _, g = heapq.heappop(heap)
                done = fill(g, min(g[5], left), 1)
                for part in (g, done):
                    if part[5] and room(part):
                        heapq.heappush(heap, (-dot(part), part[4], part))
                    elif part[5]:
                        made.append(part)
            made += [g for _, _, g in heap]
        if left:  # open new bins
            fits = room(full.tolist())
            g = [*full.tolist(), 0, fresh, -(-left // fits)]
            fresh += g[5]
            if left >= fits:
                made.append(fill(g, left // fits, fits))
            if left:
                made.append(fill(g, 1, left))
        groups = np.concatenate([groups, np.array(made, np.int64).reshape(-1, 6)])
        groups = groups[(groups[:, 5] > 0) & (groups[:, 0] > 0)]
    return runs


def place_pieces(pieces: DataFrame, limits: Capacities = Capacities(), buckets: int = BUCKETS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset."""
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    rows = stored(pieces.withColumn("bucket", bucket), "pieces")
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).select("length", "bucket", "before")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = best_fit(histogram, limits)
    keys = np.array([(length << 44) + first for length, first, *_ in runs], np.int64)
    table = np.array(runs, np.int64).reshape(-1, 6)
    by_key = np.argsort(keys)
    keys, table = keys[by_key], table[by_key]
    kind = pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())])

    @F.arrow_udf("sequence_id bigint, offset bigint")
    def look_up(length: pa.Array, number: pa.Array) -> pa.Array:
        size, k = length.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False)
        run = table[np.searchsorted(keys, (size << 44) + k, side="right") - 1]
        at = k - run[:, 1]
        return pa.StructArray.from_arrays([pa.array(run[:, 3] + at // run[:, 4]), pa.array(run[:, 5] + at % run[:, 4] * size)], fields=list(kind))

    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("number", F.row_number().over(within) - 1).join(before, ["length", "bucket"])
    placed = numbered.withColumn("place", look_up(F.col("length"), (F.col("number") + F.col("before")).cast("bigint")))
    return placed.select(*[c for c in pieces.columns], F.col("place.sequence_id").alias("sequence_id"), F.col("place.offset").alias("offset"))


def pack_documents(documents: DataFrame, tokenizer: str | None = None, limits: Capacities = Capacities(), end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    ``tokenizer``: path of a tokenizer file that every task can read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    longest = min(limits.tokens, int(limits.attention**0.5))
    cut = short_batches(documents).select(F.col("doc_id"), F.explode(pieces_udf(str(tokenizer), longest, end_id)(F.col("text"))).alias("p"))
    return place_pieces(cut.select("doc_id", "p.*"), limits)

"""Benchmark decontamination: size-partitioned MinHash containment search.

Items (short) are sought inside documents (long). An item's sketch holds, for each of k hash
functions, the item's shingle with the least value (MinHash). If a document contains the share c of the item's
shingles, each sketch entry is one of the document's shingles with probability c - whatever the
document's length, since the long side isn't sketched but probed whole. Items are partitioned by their number of
shingles (classes of doubling size); each class has its own k and its own table. One shared entry
is a candidate, so at containment 0.8 a candidate is missed with probability 0.2**k, under 1e-11.
Candidates are verified by exact containment of the word shingles themselves.

Words are runs of letters, digits and non-ASCII characters after lowering A-Z (ASCII punctuation and
white space separate them); shingles have five words. An item of fewer words is one shingle.

Benchmarks whose texts are checked to be at most ``BLOCK_BYTES`` go to every task as one index, and documents
are probed where they are read. Beyond that nothing is collected: sketch entries meet the documents'
shingles in an equi-join, and candidates are verified by joins on the shingles' texts.

Defined results: null or wordless texts and items match nothing; repeated rows and items are
matched each; ties can't arise, all matches count; empty tables give no rows; extra columns are ignored.
Texts of any length are probed whole, in memory of some 60 bytes for each of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, short_batches, stored
from .textbytes import IS_BLANK, LOWER, chunks, mixed, shingle_hashes, span_hashes, utf8_views, words_of

WORDS = 5
SIMILARITY = 0.8
CLASS_SHINGLES = 16
BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 2 << 20
#: ASCII punctuation, white space and control bytes separate words.
SEPARATES = IS_BLANK.copy()
SEPARATES[[b for b in range(128) if not chr(b).isalnum()]] = True


def size_class(shingles: int) -> int:
    """0 for items of up to 16 shingles, and one more with each doubling."""
    return max(0, (max(1, shingles) - 1).bit_length() - 4)


def sketch_size(shingles: int) -> int:
    """Hash functions for an item's size class."""
    return CLASS_SHINGLES + 4 * size_class(shingles)


def sketch(values: np.ndarray) -> np.ndarray:
    """MinHash sketch of distinct shingle hashes: the least of them under each hash function."""
    seeds = np.arange(1, sketch_size(len(values)) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(values[[int(mixed(values ^ s).argmin()) for s in seeds]])


def item_shingles(text: str | None) -> tuple[int, list[bytes]]:
    """(words per shingle, distinct shingles) of an item."""
    words = item_words(text)
    n = min(WORDS, len(words))
    return n, sorted({b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}) if n else []


def item_words(text: str | None) -> list[bytes]:
    raw, off = utf8_views(pa.array([text], pa.string()))
    raw = LOWER[raw]
    start, end, _ = words_of(raw, off, SEPARATES)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(start.tolist(), end.tolist())]


def item_hashes(text: str, n: int) -> np.ndarray:
    """Distinct hashes of an item's shingles of ``n`` words."""
    raw, off = utf8_views(pa.array([text], pa.string()))
    raw = LOWER[raw]
    start, end, first = words_of(raw, off, SEPARATES)
    return np.unique(shingle_hashes(span_hashes(raw, start, end), first, n)[0])


class ItemIndex:
    """Sketches of the items: for each size class (and words per shingle) sorted entries -> items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items: list[tuple[int | None, int, frozenset[bytes]]] = []
        entries: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item_id, text in items:
            n, shingles = item_shingles(text)
            if shingles:
                own = sketch(item_hashes(text, n)).tolist()
                entries.setdefault((size_class(len(shingles)), n), []).extend((v, len(self.items)) for v in own)
                self.items.append((item_id, n, frozenset(shingles)))
        self.tables = {}
        for part, pairs in entries.items():
            pairs.sort()
            self.tables[part] = (np.array([v for v, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64))

    def candidates(self, raw: np.ndarray, off: np.ndarray) -> dict[int, list[int]]:
        """Row -> items that share a sketch entry with it; ``raw`` is lowered."""
        start, end, first = words_of(raw, off, SEPARATES)
        words = span_hashes(raw, start, end)
        out: dict[int, set[int]] = {}
        probes = {n: shingle_hashes(words, first, n) for n in {n for _, n in self.tables}}
        for (_, n), (values, item) in self.tables.items():
            h, row = probes[n]
            low = np.searchsorted(values, h)
            hit = np.flatnonzero(values[np.minimum(low, len(values) - 1)] == h)
            high = np.searchsorted(values, h[hit], side="right")
            for r, a, b in set(zip(row[hit].tolist(), low[hit].tolist(), high.tolist())):
                out.setdefault(r, set()).update(item[a:b].tolist())
        return {r: sorted(x) for r, x in sorted(out.items())}

    def verify(self, text: bytes, items: list[int]) -> list[float]:
        """Exact share of each item's distinct shingles that stand in ``text`` (lowered bytes), split once."""
        raw = np.frombuffer(text, np.uint8)
        start, end, _ = words_of(raw, np.array([0, len(raw)]), SEPARATES)
        words = [text[a:b] for a, b in zip(start.tolist(), end.tolist())]
        found: set[bytes] = set()
        for n in {self.items[i][1] for i in items}:
            wanted = frozenset().union(*(self.items[i][2] for i in items if self.items[i][1] == n))
            found.update(s for i in range(len(words) - n + 1) if (s := b" ".join(words[i : i + n])) in wanted)
        return [len(self.items[i][2] & found) / len(self.items[i][2]) for i in items]


def matches_udf(index: ItemIndex, similarity: float = SIMILARITY):
    """Arrow UDF: text -> array<struct<item_id, containment>> of the items that it contains."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64())]))

    @F.arrow_udf("array<struct<item_id:bigint,containment:double>>")
    def match(texts: pa.Array) -> pa.Array:
        raw, off = utf8_views(texts)
        out: list[list[dict]] = []
        for a, b in chunks(np.diff(off), CHUNK_BYTES):
            part = LOWER[raw[off[a] : off[b]]]
            ends = off[a : b + 1] - off[a]
            rows: list[list[dict]] = [[] for _ in range(b - a)]
            for r, items in index.candidates(part, ends).items():
                shares = index.verify(part[ends[r] : ends[r + 1]].tobytes(), items)
                rows[r] = [{"item_id": index.items[i][0], "containment": x} for i, x in zip(items, shares) if x >= similarity]
            out += rows
        return pa.array(out, kind)

    return match.asNondeterministic()  # else a filter drawn from a later explode would search twice


# ---- beyond one index: the same search as joins ------------------------------------------------

_TEXT_KEY = ("_t1", "_t2")


def text_key(text: Column) -> list[Column]:
    """128 bits for a text: a match depends on the text alone, so copies are searched once."""
    return [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit("second"), text).alias("_t2")]


def _shingle_rows(texts: DataFrame, lengths: list[int], exact: bool) -> DataFrame:
    """(key, n, shingle) of every distinct shingle of every text: its hash, or its bytes where ``exact``."""

    def cut(batches):
        for batch in batches:
            raw, off = utf8_views(batch.column(2))
            for a, b in chunks(np.diff(off), CHUNK_BYTES):
                part, ends = LOWER[raw[off[a] : off[b]]], off[a : b + 1] - off[a]
                start, end, first = words_of(part, ends, SEPARATES)
                hashes, whole = span_hashes(part, start, end), part.tobytes()
                for n in lengths:
                    h, row = shingle_hashes(hashes, first, n)
                    if exact:
                        at = np.flatnonzero(np.arange(max(0, len(start) - n + 1)) + n <= first[np.searchsorted(first, np.arange(max(0, len(start) - n + 1)), side="right")])
                        values = [b" ".join(whole[start[j] : end[j]] for j in range(i, i + n)) for i in at.tolist()]
                        pairs = sorted(set(zip(row.tolist(), values)))
                        row, shingle = np.array([r for r, _ in pairs], np.int64), pa.array([v for _, v in pairs], pa.binary())
                    else:
                        order = np.lexsort((h, row))
                        h, row = h[order], row[order]
                        new = np.ones(len(h), bool)
                        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                        row, shingle = row[new], pa.array(h[new].astype(np.int64))
                    where = pa.array(row + a)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array([n] * len(row), pa.int32()), shingle], names=[*_TEXT_KEY, "n", "shingle"])

    return texts.mapInArrow(cut, f"_t1 long, _t2 long, n int, shingle {'binary' if exact else 'long'}")


def item_table(items: DataFrame) -> DataFrame:
    """(item, item_id, n, size, class, entries, shingles) of every item that has words."""

    def prepare(batches):
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, shingles = item_shingles(text)
                if shingles:
                    rows.append({"item_id": item_id, "n": n, "size": len(shingles), "class": size_class(len(shingles)), "entries": sketch(item_hashes(text, n)).astype(np.int64).tolist(), "shingles": shingles})
            kind = pa.schema([("item_id", pa.int64()), ("n", pa.int32()), ("size", pa.int64()), ("class", pa.int32()), ("entries", pa.list_(pa.int64())), ("shingles", pa.list_(pa.binary()))])
            yield pa.RecordBatch.from_pylist(rows, kind)

    made = items.mapInArrow(prepare, "item_id long, n int, size long, class int, entries array<long>, shingles array<binary>")
    return stored(made.withColumn("item", F.monotonically_increasing_id()), "items")


def matches_by_join(texts: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(text key, item_id, containment) of every match. ``texts``: (text key, text), keys distinct."""
    table = item_table(items)
    lengths = sorted(r["n"] for r in table.select("n").distinct().collect())  # at most WORDS of them
    entries = table.select("item", "class", "n", F.explode("entries").alias("shingle"))
    probes = _shingle_rows(texts, lengths, exact=False)
    pairs = stored(probes.join(entries, ["n", "shingle"]).select(*_TEXT_KEY, "item").distinct(), "item-candidates")
    met = texts.join(pairs.select(*_TEXT_KEY).distinct(), list(_TEXT_KEY), "left_semi")
    wanted = pairs.join(table.select("item", "n", F.explode("shingles").alias("shingle")), "item")
    found = wanted.join(_shingle_rows(met, lengths, exact=True), [*_TEXT_KEY, "n", "shingle"]).groupBy(*_TEXT_KEY, "item").agg(F.count("*").alias("found"))
    shares = found.join(table.select("item", "item_id", "size"), "item").withColumn("containment", F.col("found") / F.col("size"))
    return shares.where(F.col("containment") >= similarity).select(*_TEXT_KEY, "item_id", "containment")


def item_rows(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    return benchmark.select(F.col(key).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text"))


def small_index(items: DataFrame, block_bytes: int) -> ItemIndex | None:
    """The index over all items if their texts are checked to be at most ``block_bytes``."""
    total = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    return ItemIndex([(r["item_id"], r["text"]) for r in items.collect()]) if total <= block_bytes else None


def joined_matches(documents: DataFrame, items: DataFrame, similarity: float, text: str) -> DataFrame:
    texts = documents.where(F.col(text).isNotNull()).select(*text_key(F.col(text)), F.col(text).cast("string").alias("text"))
    return matches_by_join(short_batches(texts.dropDuplicates(list(_TEXT_KEY))), items, similarity)


def find_contained(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text", name: str = "items", key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with the array of contained items (id, containment)."""
    items = item_rows(benchmark, key, item_text)
    index = small_index(items, block_bytes)
    if index:
        return short_batches(documents).withColumn(name, matches_udf(index, similarity)(F.col(text)))
    t1, t2 = fresh(documents, 2)
    found = joined_matches(documents, items, similarity, text).groupBy(*_TEXT_KEY).agg(F.sort_array(F.collect_list(F.struct("item_id", "containment"))).alias(name))
    rows = documents.withColumns(dict(zip((t1, t2), text_key(F.col(text)))))
    out = rows.join(found, (F.col(t1) == found["_t1"]) & (F.col(t2) == found["_t2"]), "left")
    none = F.array().cast("array<struct<item_id:bigint,containment:double>>")
    return out.select(*(rows[c] for c in documents.columns), F.coalesce(found[name], none).alias(name))


def contamination(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, containment) of every item found in a document."""
    rows, items = documents.select("doc_id", "text"), item_rows(benchmark, "item_id", "text")
    index = small_index(items, block_bytes)
    if index:
        found = short_batches(rows).select("doc_id", F.explode(matches_udf(index, similarity)("text")).alias("i"))
        return found.select("doc_id", "i.item_id", "i.containment")
    return rows.select("doc_id", *text_key(F.col("text"))).join(joined_matches(rows, items, similarity, "text"), list(_TEXT_KEY)).select("doc_id", "item_id", "containment")

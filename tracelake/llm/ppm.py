"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte context tree is counted (orders 0 to ``order``). A byte's
code length under frozen statistics is -log2 c/(t+q) in the longest known context (c: the byte's
count, t: the context's total, q: its distinct bytes); if the byte is new there, the escape
-log2 q/(t+q) is paid and the next shorter context is asked, down to one in 256. The language with
the shortest code for the whole text wins; the score is its share of 2**-(code length per
``TEMPER`` bytes at most) over all languages.

All code lengths are worked out once for every known (context, byte) and every language, so a text
costs a few table look-ups per byte for all languages at once.

Training may use a bounded sample of labelled rows: about ``sample_bytes`` bytes of whole texts in
all, shared equally by the languages and chosen by a hash of id and text. Scoring covers every text whole.
More than ``MOST_LANGUAGES`` labels are refused: such a column doesn't hold languages.

Defined results: text that is null or has no letter (Unicode L) is ``und`` with score 0, as is every
text if nothing could be learned; ties go to the language first in order; null ids are training rows; repeated
rows are scored each; an empty table stays empty; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import short_batches
from .textbytes import chunks, utf8_views

ORDER = 4
SAMPLE_BYTES = 8 << 20
CHUNK_BYTES = 1 << 18
TEMPER = 64
MOST_LANGUAGES = 1000
UNKNOWN = "und"


def held_out(key: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == 0, F.lit(False))


def padded_bytes(raw: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with ``order`` line feeds before each text, indexes of the text's bytes)."""
    sizes = np.diff(off)
    at = np.arange(len(raw)) + np.repeat(np.arange(1, len(sizes) + 1) * order, sizes)
    out = np.full(len(raw) + order * len(sizes), 10, np.uint8)
    out[at] = raw
    return out, at


def grams(raw: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """``order`` bytes before and the byte itself, as one integer (the byte is lowest)."""
    key = raw[at].astype(np.uint64)
    for d in range(1, order + 1):
        key |= raw[at - d].astype(np.uint64) << np.uint64(8 * d)
    return key


class Lookup:
    """Positions of many integers in a fixed set: a few rounds of direct hashing, then a search."""

    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.rounds = []
        left = np.arange(self.n)
        for factor in self.FACTORS:
            bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 1.5))))  # each round is as large as what is left needs
            shift = np.uint64(64 - bits)
            spot = ((keys[left] * np.uint64(factor)) >> shift).astype(np.int64)
            where, first = np.unique(spot, return_index=True)
            key, value, more = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, bool)
            key[where], value[where] = keys[left[first]], left[first]
            later = np.ones(len(left), bool)
            later[first] = False
            more[spot[later]] = True
            self.rounds.append((np.uint64(factor), shift, key, value, more))
            left = left[later]
        order = np.argsort(keys[left])
        self.rest, self.rest_at = keys[left][order], left[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        open_at = np.arange(len(keys))
        now = keys
        for factor, shift, key, value, more in self.rounds:
            if not len(now):
                return out
            spot = ((now * factor) >> shift).astype(np.int64)
            v = value[spot]
            hit = (key[spot] == now) & (v >= 0)
            out[open_at[hit]] = v[hit]
            on = ~hit & more[spot]
            open_at, now = open_at[on], now[on]
        if len(now) and len(self.rest):
            spot = np.minimum(np.searchsorted(self.rest, now), len(self.rest) - 1)
            hit = self.rest[spot] == now
            out[open_at[hit]] = self.rest_at[spot[hit]]
        return out


class PpmModel:
    """Code lengths of every known (context, byte) for every language."""

    def __init__(self, languages: list[str], tables: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """``tables``: for each language the distinct full-order grams and their counts."""
        self.languages, self.order = languages, order
        size = len(languages)
        self.levels: list[tuple[Lookup, np.ndarray]] = []  # by order: grams -> bits
        self.escapes: list[tuple[Lookup, np.ndarray]] = []  # by order: contexts -> escape bits
        shorter: np.ndarray | None = None
        shorter_at: Lookup | None = None
        for k in range(order + 1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            found = []
            for keys, counts in tables:
                every, at = np.unique(keys & mask, return_inverse=True)
                found.append((every, np.bincount(at, counts, len(every))))
            union = np.unique(np.concatenate([x for x, _ in found])) if found else np.zeros(0, np.uint64)
            contexts = np.unique(union >> np.uint64(8))
            bits, escape = np.zeros((len(union), size), np.float32), np.zeros((len(contexts), size), np.float32)
            context_of = np.searchsorted(contexts, union >> np.uint64(8))
            if k == 0:
                below = np.full((len(union), size), 8.0, np.float32)
            else:
                below = shorter[shorter_at(union & np.uint64((1 << (8 * k)) - 1))]
            for j, (every, counts) in enumerate(found):
                own, at = np.unique(every >> np.uint64(8), return_inverse=True)
                total, distinct = np.bincount(at, counts), np.bincount(at)
                escape[np.searchsorted(contexts, own), j] = -np.log2(distinct / (total + distinct))
                bits[:, j] = escape[context_of, j] + below[:, j]
                bits[np.searchsorted(union, every), j] = -np.log2(counts / (total[at] + distinct[at]))
            shorter, shorter_at = bits, Lookup(union)
            self.levels.append((shorter_at, bits))
            self.escapes.append((Lookup(contexts), escape))

    def byte_bits(self, keys: np.ndarray) -> np.ndarray:
        """Exact code length of each full-order gram's last byte, for every language."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        open_at, now = np.arange(len(keys)), keys
        for k in range(self.order, -1, -1):
            lookup, bits = self.levels[k]
            spot = lookup(now)
            hit = spot >= 0
            out[open_at[hit]] += bits[spot[hit]]
            open_at, now = open_at[~hit], now[~hit]
            if not len(now):
                return out
            contexts, escape = self.escapes[k]
            spot = contexts(now >> np.uint64(8))
            known = spot >= 0
            out[open_at[known]] += escape[spot[known]]
            now = now & np.uint64((1 << (8 * k)) - 1) if k else now
        out[open_at] += 8.0
        return out

    def text_bits(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each whole text for every language."""
        out = np.zeros((len(off) - 1, len(self.languages)))
        for a, b in chunks(np.diff(off), CHUNK_BYTES):
            part, at = padded_bytes(raw[off[a] : off[b]], off[a : b + 1] - off[a], self.order)
            for s in range(0, len(at), CHUNK_BYTES):  # a very long text goes in pieces, all of it counts
                bits = self.byte_bits(grams(part, at[s : s + CHUNK_BYTES], self.order)).astype(np.float64)
                edges = np.clip(off[a : b + 1] - off[a] - s, 0, len(bits))
                sums = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits, 0)])
                out[a:b] += sums[edges[1:]] - sums[edges[:-1]]
        return out


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> PpmModel:
    """Count context trees of the labelled rows that aren't held out (a bounded sample, see above)."""
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("k")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels in {lang}")
    share = {x: min(1.0, sample_bytes / len(sizes) / max(1, n)) for x, n in sizes.items()}
    if not share:
        return PpmModel([], [], order)
    limit = F.create_map(*[y for x, s in sorted(share.items()) for y in (F.lit(x), F.lit(s))])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "k", "text"), F.lit(1_000_003)) / 1_000_003 < limit[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            for name in pc.unique(batch.column(0)).to_pylist():
                raw, off = utf8_views(lowered(batch.column(1).filter(pc.equal(batch.column(0), name))))
                keys, n = np.unique(grams(*padded_bytes(raw, off, order), order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(share)
    tables = [(x["gram"].to_numpy().astype(np.uint64), x["n"].to_numpy().astype(np.float64)) for x in (counted[counted["lang"] == name] for name in languages)]
    return PpmModel(languages, tables, order)


def language_udf(spark: SparkSession, trained: PpmModel):
    """Arrow UDF: text -> (lang_pred, score, bits_per_byte of the winner).

    The model is bounded by its training sample; a broadcast is loaded once by each worker, not by each task.
    """
    shared = spark.sparkContext.broadcast(trained)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    @F.arrow_udf("lang_pred string, score double, bits_per_byte double")
    def identify(texts: pa.Array) -> pa.Array:
        model = shared.value
        raw, off = utf8_views(lowered(texts))
        if not model.languages:
            return pa.array([{"lang_pred": UNKNOWN, "score": 0.0, "bits_per_byte": None}] * len(texts), kind)
        bits = model.text_bits(raw, off)
        best = bits.argmin(1)
        size = np.maximum(1, np.diff(off))
        gap = (bits - bits.min(1, keepdims=True)) * np.minimum(1.0, TEMPER / size)[:, None]
        score = 1.0 / np.exp2(-gap).sum(1)
        names = pa.array(model.languages, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(score), pa.array(bits.min(1) / size)], fields=list(kind))

    return identify


def identify_languages(documents: DataFrame, model: PpmModel | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", name: str = "language") -> DataFrame:
    """``documents`` with a struct column ``name``: lang_pred and score."""
    documents = short_batches(documents)
    model = model or train(documents, key, text, lang)
    found = documents.withColumn(name, language_udf(documents.sparkSession, model)(F.col(text)))
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    und = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    return found.withColumn(name, F.when(has_letter, F.col(name)).otherwise(und))


def plain_bits(text: bytes, table: dict[bytes, int], order: int = ORDER) -> float:
    """Code length of one text by the definition, without tables (for tests). ``table``: gram counts."""
    total: dict[bytes, int] = {}
    distinct: dict[bytes, int] = {}
    counts: dict[bytes, int] = {}
    for gram, n in table.items():
        for k in range(order + 1):
            counts[gram[order - k :]] = counts.get(gram[order - k :], 0) + n
    for gram, n in counts.items():
        total[gram[:-1]] = total.get(gram[:-1], 0) + n
        distinct[gram[:-1]] = distinct.get(gram[:-1], 0) + 1
    bits, whole = 0.0, b"\n" * order + text
    for i in range(order, len(whole)):
        for k in range(order, -1, -1):
            context, gram = whole[i - k : i], whole[i - k : i + 1]
            if gram in counts:
                bits -= np.log2(counts[gram] / (total[context] + distinct[context]))
                break
            if context in total:
                bits -= np.log2(distinct[context] / (total[context] + distinct[context]))
        else:
            bits += 8.0
    return bits

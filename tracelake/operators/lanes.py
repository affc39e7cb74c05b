"""Correlation lanes: clusters of events that share a key, and keyword pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.association import df_threshold, pair_signal
from ..functions.normalize import is_blank, is_noise_keyword, key_token
from ..functions.normalize import keyword as normal_keyword

#: Lanes from the most to the least telling (fixed values).
LANE_ORDER = ("kw_pair", "same_keyword", "same_entity", "same_uei", "same_award_id", "same_contract_id", "same_doc_id", "same_agency", "same_psc", "same_naics", "same_place_region", "same_sam_naics", "sam_usaspending_candidate_join")


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _tagged(df: DataFrame, *names: tuple[str, str], upper: bool = True) -> Column:
    """First present column as ``tag:VALUE``."""
    return F.coalesce(*[F.when(~is_blank(_optional(df, n)), F.concat(F.lit(f"{tag}:"), key_token(_optional(df, n), upper))) for tag, n in names])


def lane_keys(df: DataFrame) -> dict[str, Column]:
    """The key of an event in each same-field lane; null where it has none."""
    token = lambda n, upper=True: key_token(_optional(df, n), upper)
    country = F.coalesce(token("country"), F.lit("USA"))
    region = F.coalesce(F.concat(country, F.lit(":"), token("state")), F.concat(country, F.lit(":ZIP"), F.substring(token("zip"), 1, 3)))
    return {
        "same_entity": _optional(df, "entity_id"),
        "same_uei": token("recipient_uei"),
        "same_award_id": F.coalesce(token("award_id"), token("generated_unique_award_id")),
        "same_contract_id": _tagged(df, ("piid", "piid"), ("fain", "fain"), ("uri", "uri")),
        "same_doc_id": _tagged(df, ("document", "document_id"), ("notice", "notice_id"), ("doc", "doc_id"), ("sol", "solicitation_number")),
        "same_agency": F.coalesce(token("agency_code"), token("funding_agency_code"), token("office_code"), *[token(n, False) for n in ("agency_name", "funding_agency_name", "office_name")]),
        "same_psc": token("psc"),
        "same_naics": token("naics"),
        "same_place_region": region,
    }


def clusters(rows: DataFrame, lane: Column, key: Column, min_events: int = 2, max_events: int | None = 200, prefix: str = "*|30") -> DataFrame:
    """(lane, key, correlation_key, event_count, score): keys held by enough and not too many distinct events.

    Counting is a partial aggregation; members aren't collected (see ``links``).
    """
    if min_events < 2 or (max_events is not None and max_events < min_events):
        raise ValueError("min_events is at least 2 and at most max_events")
    n = rows.select(lane.alias("lane"), key.alias("key"), "id").where("key is not null").groupBy("lane", "key").agg(F.count_distinct("id").alias("event_count"))
    kept = n.where((F.col("event_count") >= min_events) & (F.lit(True) if max_events is None else F.col("event_count") <= max_events))
    return kept.select("lane", "key", F.concat_ws("|", "lane", F.lit(prefix), "key").alias("correlation_key"), "event_count", F.col("event_count").cast("double").alias("score"))


def unpivoted(df: DataFrame, lanes: tuple[str, ...]) -> DataFrame:
    """One scan for all lanes: (id, lane, key)."""
    keys = lane_keys(df)
    pairs = F.array(*[F.struct(F.lit(x).alias("lane"), keys[x].alias("key")) for x in lanes])
    return df.select("id", F.explode(pairs).alias("p")).select("id", "p.lane", "p.key").where("key is not null")


def same_field(df: DataFrame, lanes: tuple[str, ...], **limits) -> DataFrame:
    return clusters(unpivoted(df, lanes), F.col("lane"), F.col("key"), **limits)


def keyword_clusters(df: DataFrame, min_events: int = 3, max_events: int | None = 200) -> DataFrame:
    words = df.select("id", F.explode("keywords").alias("k"))
    return clusters(words, F.lit("same_keyword"), F.when(normal_keyword(F.col("k")) != "", normal_keyword(F.col("k"))), min_events, max_events)


def links(df: DataFrame, found: DataFrame, lanes: tuple[str, ...]) -> DataFrame:
    """(correlation_key, event_id) of every member."""
    members = unpivoted(df, lanes)
    return members.join(found.select("lane", "key", "correlation_key"), ["lane", "key"]).select("correlation_key", F.col("id").alias("event_id")).distinct()


def key_report(df: DataFrame, lane: str, min_events: int = 2, max_events: int = 200, top: int = 20) -> DataFrame:
    """The most frequent keys of a lane with their status."""
    n = unpivoted(df, (lane,)).groupBy("key").agg(F.count_distinct("id").alias("event_count"))
    status = F.when(F.col("event_count") > max_events, "capped").when(F.col("event_count") < min_events, "below_min").otherwise("eligible")
    return n.withColumn("status", status).orderBy(F.desc("event_count"), F.desc("key")).limit(top)


def first_metadata(df: DataFrame, lane: str, column: str) -> DataFrame:
    """Per key the first non-blank value of a column in id order."""
    rows = df.select(lane_keys(df)[lane].alias("key"), "id", F.col(column).alias("v")).where("key is not null")
    return rows.groupBy("key").agg(F.min_by("v", F.when(~is_blank(F.col("v")), F.col("id"))).alias(column))


def top_label(df: DataFrame, lane: str, column: str) -> DataFrame:
    """Per key the most frequent value (on a tie the last in order) and how often it occurs."""
    n = df.select(lane_keys(df)[lane].alias("key"), F.col(column).alias("v")).where("key is not null and v is not null").groupBy("key", "v").agg(F.count("*").alias("n"))
    return n.groupBy("key").agg(F.max(F.struct("n", "v")).alias("m")).select("key", F.col("m.v").alias(column), F.col("m.n").alias("n"))


def keyword_pairs(df: DataFrame, min_pair_count: int = 3, max_events: int | None = 200, max_keywords: int = 10, ratio: float = 0.2, floor: int = 8, smoothing: float = 0.5, store: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Co-occurring keywords with NPMI: noise packs and frequent keywords go first, then pairs are made.

    With ``store``, which writes a table to shared storage and reads it back, the events are read once, for a table of (id, keyword) and the
    counts of all keywords.

    ``max_keywords`` is the operator's own rule: events with more surviving keywords are left out.
    """
    # an event without keywords counts too: its row has none
    every = store(df.select("id", F.explode_outer("keywords").alias("k")).select("id", normal_keyword(F.col("k")).alias("k")).distinct(), "words")
    words = every.where(F.col("k").isNotNull() & ~is_noise_keyword(F.col("k")))
    total = store(every.agg(F.count_distinct("id").alias("total")), "total")
    df_counts = store(words.groupBy("k").agg(F.count("*").alias("c")), "keywords")
    allowed = df_counts.crossJoin(F.broadcast(total)).where((df_threshold(F.col("total"), ratio, floor) == 0) | (F.col("c") <= df_threshold(F.col("total"), ratio, floor)))
    per_event = words.join(allowed.select("k"), "k", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("k")).alias("ks")).where(F.size("ks").between(2, max_keywords))
    pair_lists = F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda b: F.struct(a.alias("k1"), b.alias("k2")))))
    pairs = per_event.select(F.explode(pair_lists).alias("p")).groupBy("p.k1", "p.k2").agg(F.count("*").alias("c12")).where((F.col("c12") >= min_pair_count) & (F.lit(True) if max_events is None else F.col("c12") <= max_events))
    out = pairs.join(df_counts.select(F.col("k").alias("k1"), F.col("c").alias("c1")), "k1").join(df_counts.select(F.col("k").alias("k2"), F.col("c").alias("c2")), "k2").crossJoin(F.broadcast(total))
    signal = pair_signal(F.col("total"), F.col("c1"), F.col("c2"), F.col("c12"), smoothing)
    key = F.concat(F.lit("kw_pair|*|30|pair:"), F.substring(F.sha1(F.concat("k1", F.lit("+"), "k2")), 1, 16))
    return out.select(key.alias("correlation_key"), "k1", "k2", "c1", "c2", "c12", *[F.bround(c, 6).alias(n) for n, c in signal.items()])


def pair_links(df: DataFrame, found: DataFrame) -> DataFrame:
    """(correlation_key, event_id) of the events that hold both keywords of a pair.

    Words that are in no found pair go first, so that an event meets only pairs of words that some pair has.
    """
    paired = found.select(F.explode(F.array("k1", "k2")).alias("k")).distinct()
    words = df.select(F.col("id").alias("event_id"), F.explode(F.array_distinct(F.transform("keywords", normal_keyword))).alias("k")).join(paired, "k", "left_semi")
    ks = words.groupBy("event_id").agg(F.array_sort(F.collect_set("k")).alias("ks")).where(F.size("ks") > 1)
    both = F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda b: F.struct(a.alias("k1"), b.alias("k2")))))
    rows = ks.select("event_id", F.explode(both).alias("p")).select("event_id", "p.*")
    return rows.join(found.select("correlation_key", "k1", "k2"), ["k1", "k2"]).select("correlation_key", "event_id")


def reconcile(old: DataFrame, new: DataFrame, columns: tuple[str, ...] = ("event_count",)) -> DataFrame:
    """What a rebuild does to each correlation key: created, updated, unchanged or deleted."""
    o = old.select("correlation_key", F.struct(*columns).alias("o"))
    n = new.select("correlation_key", F.struct(*columns).alias("n"))
    status = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "deleted").when(F.col("o") == F.col("n"), "unchanged").otherwise("updated")
    return o.join(n, "correlation_key", "full_outer").select("correlation_key", status.alias("status"))

"""URL filtering by hashed host-suffix and path-prefix expressions, in DataFrame functions only.

A rule is (host, path, verdict): it fits its host and all subdomains where the url's path starts
with the rule's path. Each url expands into the suffixes of its host with every path prefix, for the numbers
of labels and the lengths that some rule has. Expressions meet rules in an equi-join on the first four bytes of their
SHA-256; the full digest confirms. The longest rule wins (characters of host and path together; on
a tie block before allow, then the rule's text).

The rules are sent to all tasks only if their number is checked to be at most ``BROADCAST_RULES``;
beyond it the join is shuffled. What a url expands into depends on the rules alone: a url of many thousand
labels or characters costs no more expressions than a short one.

Defined results: a url that is null or without ``://`` has an empty host and path and gets the
default verdict, as does every url that no rule fits; repeated rows are judged each; repeated rules
count once; an empty rule table leaves the default; rules with a null or empty host are void; extra columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
DEFAULT = "allow"
#: The production rules (fixed values).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All (suffix, prefix) pairs of a url: suffixes of the given numbers of labels, prefixes of the given lengths."""
    dots = F.length(host) - F.length(F.translate(host, ".", ""))
    suffixes = F.array(*[F.when(dots >= n - 1, F.substring_index(host, ".", -n)) for n in labels])
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    known = lambda x: F.filter(x, lambda e: e.isNotNull())
    return F.flatten(F.transform(known(suffixes), lambda s: F.transform(known(prefixes), lambda p: F.struct(s.alias("host"), p.alias("prefix")))))


def digest(host: Column, path: Column) -> Column:
    """Hosts hold no slash and rule paths begin with one, so the joined text is unambiguous."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(``keep`` columns, host, path, rule, verdict) of every url."""
    valid = rules.where("host is not null and host != '' and path is not null and verdict in ('allow', 'block')").select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    keyed = valid.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("rule_digest", 1, 8))
    shapes = valid.select(F.length("rule_path").alias("length"), F.size(F.split("rule_host", r"\.")).alias("labels"))
    lengths, labels = (sorted(r[0] for r in shapes.select(c).distinct().collect()) for c in ("length", "labels"))
    rows = pages.select(*keep, F.col(url).cast("string").alias("_url")).select(F.monotonically_increasing_id().alias("_row"), *keep, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    if not lengths:
        return rows.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    fits = F.filter(expressions(F.col("host"), F.col("path"), labels, lengths), lambda e: e["host"] != "")
    spread = rows.select("*", F.explode_outer(fits).alias("e")).withColumn("digest", digest(F.col("e.host"), F.col("e.prefix")))
    if keyed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    spread = spread.withColumn("short", F.substring("digest", 1, 8)).drop("e")
    met = spread.join(keyed, "short", "left").withColumn("ok", F.coalesce(F.col("digest") == F.col("rule_digest"), F.lit(False)))
    text = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(text).alias("size"), (F.col("rule_verdict") == "block").alias("blocks"), text.alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = met.groupBy("_row", *keep, "host", "path").agg(F.max(F.when(F.col("ok"), rank)).alias("best"))
    return best.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

"""Rule tagging of texts: one generated expression per rule, all in the JVM."""

from __future__ import annotations

import re

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import bounded_json
from .terms import contained

CHUNK = 100
MOST_RULES = 10_000


def rule_list(rules: list[dict] | DataFrame) -> list[dict]:
    """Rules as dicts. A rule table is read whole if it is checked to have at most ``MOST_RULES`` rows; regexes that aren't valid are dropped (see ``invalid_rules``)."""
    if isinstance(rules, DataFrame):
        rows = rules.limit(MOST_RULES + 1).collect()
        if len(rows) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        rules = [r.asDict(recursive=True) for r in rows]
    bad = {id(r) for r in invalid_rules(rules)}
    return [r for r in rules if id(r) not in bad]


def java_pattern(pattern: str, blind: bool) -> str:
    """A pattern as Spark's engine takes it: named groups and references to them in its spelling, ignoring case by a flag."""
    return ("(?i)" if blind else "") + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern).replace("(?P<", "(?<")


def invalid_rules(rules: list[dict]) -> list[dict]:
    """The regex rules that are null, or that Python's or Spark's engine refuses: what ``rule_list`` drops.

    Rules are written for Python; Spark runs them. Spark is asked for all patterns in one query, and for halves of those among which some are refused.
    """

    def refused(some: list[dict]) -> list[dict]:
        if not some:
            return []
        try:
            spark.range(1).select(*[F.col("id").cast("string").rlike(java_pattern(r["pattern"], r.get("case_insensitive") is not False)).alias(str(k)) for k, r in enumerate(some)]).collect()
            return []
        except (PySparkException, Py4JJavaError):
            return some if len(some) == 1 else refused(some[: len(some) // 2]) + refused(some[len(some) // 2 :])

    regexes = [r for r in rules if r["type"] != "phrase"]
    bad = [r for r in regexes if not valid_regex(r["pattern"])]
    spark = SparkSession.getActiveSession()
    known = {id(r) for r in bad}
    return bad + (refused([r for r in regexes if id(r) not in known]) if spark else [])


def valid_regex(pattern: str | None) -> bool:
    """Whether Python's engine takes a pattern."""
    try:
        return pattern is not None and bool(re.compile(pattern))
    except re.error:
        return False


def rule_hits(rules: list[dict], fields: dict[str, Column]) -> Column:
    """Array of clauses (pack, rule, type, weight, field, match) ordered by pack, rule, field, match."""
    hits: list[Column] = []
    for r in rules:
        for f in r.get("fields") or list(fields):
            if f not in fields:
                continue
            text, blind = F.coalesce(fields[f], F.lit("")), r.get("case_insensitive") is not False
            if r["type"] == "phrase":
                found = F.contains(F.lower(text), F.lit(r["pattern"].lower())) if blind else F.contains(text, F.lit(r["pattern"]))
                match = F.lit(r["pattern"])
            else:
                match = F.regexp_substr(text, F.lit(java_pattern(r["pattern"], blind)))
                found = match.isNotNull()
            hits.append(F.when(found, F.struct(F.lit(r["pack"]).alias("pack"), F.lit(r["rule"]).alias("rule"), F.lit(f).alias("field"), match.alias("match"), F.lit(r["type"]).alias("type"), F.lit(int(r["weight"])).alias("weight"))))
    if not hits:
        return F.array().cast("array<struct<pack:string,rule:string,field:string,match:string,type:string,weight:int>>")
    parts = [F.array_compact(F.array(*hits[i : i + CHUNK])) for i in range(0, len(hits), CHUNK)]
    return F.array_sort(F.concat(*parts) if len(parts) > 1 else parts[0])


def tag(df: DataFrame, rules: list[dict] | DataFrame, fields: tuple[str, ...] = ("snippet",)) -> DataFrame:
    """``df`` with ``clauses``, ``keywords`` (sorted distinct pack:rule) and ``tag_score``."""
    tagged = df.withColumn("clauses", rule_hits(rule_list(rules), {f: F.col(f) for f in fields}))
    keywords = F.array_sort(F.array_distinct(F.transform("clauses", lambda c: F.concat_ws(":", c["pack"], c["rule"]))))
    return tagged.withColumn("keywords", keywords).withColumn("tag_score", F.aggregate("clauses", F.lit(0), lambda a, c: a + c["weight"]))


def changes(df: DataFrame, old: str = "old_keywords", old_clauses: str = "old_clauses") -> DataFrame:
    """Counters of an apply run: scanned, updated and unchanged rows. A row is unchanged if its keywords are, and its clauses too where ``old_clauses`` has the former ones."""
    same = F.coalesce(F.array_sort(F.col(old)), F.array()) == F.col("keywords")
    if old_clauses in df.columns:
        fields = ("pack", "rule", "field", "match", "type", "weight")
        plain = lambda c: F.array_sort(F.transform(F.coalesce(F.col(c), F.array().cast(dict(df.dtypes)["clauses"])), lambda x: F.struct(*[x[f].alias(f) for f in fields])))
        same = same & (plain(old_clauses) == plain("clauses"))
    return df.agg(F.count("*").alias("scanned"), F.count_if(~same).alias("updated"), F.count_if(same).alias("unchanged"))


def rule_summary(df: DataFrame, key: str = "id", samples: int = 0) -> DataFrame:
    """Per matched rule: events, clauses, average and greatest weight; with ``samples``, so many of its fields and matches, the first in order."""
    c = df.select(key, F.explode("clauses").alias("c")).select(key, "c.*")
    out = c.groupBy("pack", "rule").agg(F.count_distinct(key).alias("event_count"), F.count("*").alias("clause_count"), F.bround(F.avg("weight"), 2).alias("avg_weight"), F.max("weight").alias("max_weight"))
    for column, name in (("field", "sample_fields"), ("match", "sample_matches")) if samples else ():
        out = out.join(first_values(c, ("pack", "rule"), column, samples, name), ["pack", "rule"], "left")
    return out


def first_values(df: DataFrame, keys: tuple[str, ...], column: str, most: int, name: str) -> DataFrame:
    """Per key the first ``most`` distinct values in order, found in buckets first, so that no key's values meet in one task."""
    from pyspark.sql.window import Window

    rows = df.select(*keys, column).where(F.col(column).isNotNull()).distinct().withColumn("_bucket", F.pmod(F.xxhash64(column), F.lit(64)))
    few = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(column))).where(F.col("_k") <= most)
    return few.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(column)), 1, most).alias(name))


def event_rules(df: DataFrame, key: str = "id") -> DataFrame:
    """Per event and rule: clauses and greatest weight."""
    return df.select(key, F.explode("clauses").alias("c")).groupBy(key, "c.pack", "c.rule").agg(F.count("*").alias("clause_count"), F.max("c.weight").alias("max_weight"))


def term_hits(text: Column, terms: list[str]) -> Column:
    """How many terms occur as whole words, ignoring case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.rlike(rf"\b{re.escape(t.lower())}\b").cast("int") for t in terms), F.lit(0))


def hunt(df: DataFrame, text: str, tech: list[str], platforms: list[str], orgs: list[str]) -> DataFrame:
    """3 a technical term, 2 a platform, 1 an organisation."""
    c = F.col(text)
    return df.withColumn("hunt_score", 3 * term_hits(c, tech) + 2 * term_hits(c, platforms) + term_hits(c, orgs))


def best_of(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """One row per key: the first in order."""
    from pyspark.sql.window import Window

    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def _named(spark, names: list[str]):
    """Arrow UDF: places in a list of names -> the sorted distinct names."""
    sent = spark.sparkContext.broadcast(names)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def named(places: pa.Array) -> pa.Array:
        return pa.array([sorted({sent.value[i] for i in x}) for x in places.to_pylist()], pa.list_(pa.string()))

    return named


#: With more terms than this a table of terms and one pass over each text replace one expression for each term.
MANY_TERMS = 300


def pack_terms(df: DataFrame, text: Column, packs: dict[str, list[str]], column: str = "keywords") -> DataFrame:
    """``df`` whose empty keyword arrays are filled with pack:term for every term that the text contains, ignoring case."""
    listed = [(w, f"{pack}:{w}") for pack, terms in packs.items() for w in terms]
    if len(listed) > MANY_TERMS:
        rows = df.sparkSession.createDataFrame([(w, k) for k, (w, _) in enumerate(listed)], "term string, value long")
        found = _named(df.sparkSession, [name for _, name in listed])(contained(text, rows))
    else:
        low = F.lower(F.coalesce(text, F.lit("")))
        hits = [F.when(low.contains(w.lower()), F.lit(name)) for w, name in listed]
        parts = [F.array_compact(F.array(*hits[i : i + CHUNK])) for i in range(0, len(hits), CHUNK)] or [F.array().cast("array<string>")]
        found = F.array_sort(F.array_distinct(F.concat(*parts)))
    empty = (F.size(F.coalesce(F.col(column), F.array().cast("array<string>"))) == 0) if column in df.columns else F.lit(True)
    return df.withColumn(column, F.when(empty, found).otherwise(F.col(column)) if column in df.columns else found)


def split_query(q: Column) -> Column:
    """Parts of a query between OR (any case) and commas, without blanks and quotes around them."""
    parts = F.filter(F.transform(F.split(q, r"(?i)\s+OR\s+|,"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(parts, lambda p: F.btrim(F.btrim(p, F.lit('"')), F.lit("'")))).otherwise(F.array(q))


def hunt_rows(source: str, df: DataFrame, key: str, title: Column, amount: Column | None = None, at: Column | None = None) -> DataFrame:
    """One row shape for every hunted source: (source, key, title, amount, at)."""
    none = lambda kind: F.lit(None).cast(kind)
    return df.select(F.lit(source).alias("source"), F.col(key).cast("string").alias("key"), title.alias("title"), (none("double") if amount is None else amount.cast("double")).alias("amount"), (none("timestamp") if at is None else at.cast("timestamp")).alias("at"))


#: What of an event is tagged (fixed values).
TAGGABLE = ("snippet", "place_text", "doc_id", "source_url", "raw_json")


def taggable_fields(df: DataFrame, most: int = 65536) -> DataFrame:
    """``df`` with the fields that are tagged, as texts: what is missing is empty, raw records are bounded JSON with sorted keys (``normalize.bounded_json``)."""
    kinds = dict(df.dtypes)

    def text(name: str) -> Column:
        if name not in kinds:
            return F.lit("")
        c = F.to_json(name) if kinds[name].startswith(("struct", "map", "array", "variant")) else F.col(name).cast("string")
        return F.coalesce(bounded_json(c, most) if name == "raw_json" else c, F.lit(""))

    return df.withColumns({n: text(n) for n in TAGGABLE})

"""Lead families: evidence of a lead joined with a taxonomy of weights, and reports over the assignments.

The taxonomy is data: ``families`` (family, label, scope, min_total, min_ontology, min_corroboration) and
``weights`` (family, kind, key, weight, specific), where kind is rule, pack, hint, lane, candidate or source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAMILIES = "family string, label string, scope string, min_total int, min_ontology int, min_corroboration int"
WEIGHTS = "family string, kind string, key string, weight int, specific boolean"
#: How far behind the runner-up a secondary family may be, and how many there may be (fixed values).
SECONDARY_MARGIN, SECONDARIES = 3, 3
KINDS = {"pack_weights": "pack", "rule_weights": "rule", "hint_weights": "hint", "lane_weights": "lane", "candidate_evidence_weights": "candidate", "source_weights": "source"}


def read_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(families, weights) from one JSON object: family -> label, scope, minima and weight objects."""
    of = "map<string,int>"
    spec = f"struct<label:string,scope:string,min_total_score:int,min_ontology_score:int,min_corroboration_score:int,specific_lanes:array<string>,specific_candidate_evidence:array<string>,{','.join(f'{k}:{of}' for k in KINDS)}>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{spec}>")).alias("family", "s"))
    default = lambda c, n: F.coalesce(F.col(f"s.{c}"), F.lit(n))
    families = rows.select("family", F.coalesce("s.label", F.replace("family", F.lit("_"), F.lit(" "))).alias("label"), default("scope", "specialized").alias("scope"), default("min_total_score", 1).alias("min_total"), default("min_ontology_score", 1).alias("min_ontology"), default("min_corroboration_score", 0).alias("min_corroboration"))
    listed = F.map_concat(*[F.coalesce(F.transform_keys(f"s.{c}", lambda k, _, kind=kind: F.concat(F.lit(f"{kind}|"), k)), F.create_map().cast(of)) for c, kind in KINDS.items()])
    w = rows.select("family", "s", F.explode(listed).alias("name", "weight"))
    w = w.select("family", F.substring_index("name", "|", 1).alias("kind"), F.expr("substr(name, length(substring_index(name, '|', 1)) + 2)").alias("key"), "weight", "s")
    special = F.when(F.col("kind") == "lane", F.array_contains("s.specific_lanes", F.col("key"))).when(F.col("kind") == "candidate", F.array_contains("s.specific_candidate_evidence", F.col("key")))
    return families, w.select("family", "kind", "key", "weight", F.coalesce(special, F.lit(False)).alias("specific"))


def ontology_index(hits: DataFrame) -> DataFrame:
    """(id, pack, rule, weight): each rule of a lead once, from its first source (``origin``: 0 clauses, 1 rules, 2 signals)."""
    chosen = hits.where("pack is not null and rule is not null").groupBy("id", F.lower("pack").alias("pack"), F.lower("rule").alias("rule"))
    return chosen.agg(F.min_by(F.coalesce("weight", F.lit(1)), F.struct("origin", F.coalesce("weight", F.lit(1)))).alias("weight"))


def corroboration_summary(evidence: DataFrame) -> DataFrame:
    """Per lead and lane: how often it occurs. ``evidence`` has (id, kind, key, item)."""
    return evidence.where("kind = 'lane'").groupBy("id", F.col("key").alias("lane")).agg(F.count_distinct("item").alias("links"))


def family_scores(ontology: DataFrame, evidence: DataFrame, families: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores of every family that a lead meets the minima of.

    A rule weighs what the family gives the rule, else its pack, plus up to two for its own weight. Lanes,
    hints and sources count once each, candidate evidence once per join (``item``).
    """
    w = weights.where("weight > 0").select("family", "kind", F.lower("key").alias("key"), "weight", "specific")
    rule = ontology.select("id", F.concat_ws(":", "pack", "rule").alias("rule_key"), F.col("weight").alias("own"), F.explode(F.array(F.struct(F.lit("rule").alias("kind"), F.concat_ws(":", "pack", "rule").alias("key")), F.struct(F.lit("pack").alias("kind"), F.col("pack").alias("key")))).alias("k"))
    # a rule's own entry decides even where it is not positive, so the filter on weights comes after
    all_w = weights.select("family", "kind", F.lower("key").alias("key"), "weight")
    hit = rule.select("id", "rule_key", "own", "k.kind", "k.key").join(all_w.where("kind in ('rule', 'pack')"), ["kind", "key"])
    per_rule = hit.groupBy("id", "family", "rule_key").agg(F.max_by("weight", "kind").alias("weight"), F.first("own").alias("own")).where("weight > 0")
    gain = F.col("weight") + F.greatest(F.lit(0), F.least(F.lit(2), F.col("own") - 1))
    from_rules = per_rule.select("id", "family", F.lit("ontology").alias("part"), gain.alias("points"), F.lit(False).alias("specific"))
    once = evidence.select("id", "kind", F.lower("key").alias("key"), F.when(F.col("kind") == "candidate", F.col("item")).alias("item")).distinct()
    other = once.join(w.where("kind not in ('rule', 'pack')"), ["kind", "key"])
    from_other = other.select("id", "family", F.when(F.col("kind") == "hint", "hint").otherwise("corroboration").alias("part"), F.col("weight").alias("points"), "specific")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("points"))), F.lit(0))
    part, special = F.col("part"), F.col("specific")
    sums = from_rules.union(from_other).groupBy("id", "family").agg(
        of(part == "ontology").alias("ontology"),
        of(part == "hint").alias("hint"),
        of(part == "corroboration").alias("corroboration"),
        of((part == "corroboration") & special).alias("specific"),
        of((part == "corroboration") & ~special).alias("context"),
        F.count_if(part == "ontology").alias("rules"),
    )
    out = sums.withColumn("total", F.expr("ontology + hint + corroboration")).join(families, "family")
    out = out.where("ontology >= min_ontology and corroboration >= min_corroboration and total >= min_total")
    picked = F.expr("total + least(ontology, 3) + least(rules, 2) + least(specific, 3) - if(scope = 'fallback', least(context, 3), 0)")
    return out.withColumn("selection", picked).drop("min_total", "min_ontology", "min_corroboration")


ORDER = [F.desc, F.desc, F.desc, F.desc, F.desc, F.desc, F.asc], ("selection", "total", "ontology", "specific", "hint", "corroboration", "family")


def assigned(scores: DataFrame) -> DataFrame:
    """Places of the families of each lead; ``role`` is primary, secondary (close to the runner-up) or other."""
    by = Window.partitionBy("id")
    ordered = by.orderBy(*[f(c) for f, c in zip(*ORDER)])
    out = scores.withColumn("place", F.row_number().over(ordered))
    runner_up = F.max(F.when(F.col("place") == 2, F.col("selection"))).over(by)
    near = (F.col("place") > 1) & (F.col("place") <= 1 + SECONDARIES) & (runner_up - F.col("selection") <= SECONDARY_MARGIN)
    return out.withColumn("role", F.when(F.col("place") == 1, "primary").when(near, "secondary").otherwise("other"))


def selection_summary(places: DataFrame, considered: int = 5) -> DataFrame:
    """Per lead: the primary family, its margin to the runner-up, and the first few in order."""
    pick = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    named = F.filter(F.array_sort(F.collect_list(F.when(F.col("place") <= considered, F.struct("place", "family")))), lambda x: x.isNotNull())
    out = places.groupBy("id").agg(pick(1, "family").alias("lead_family"), pick(2, "family").alias("runner_up"), (pick(1, "selection") - pick(2, "selection")).alias("margin"), F.count("*").alias("families"), F.transform(named, lambda x: x["family"]).alias("considered"))
    return out


def group_summary(leads: DataFrame, places: DataFrame, family: str | None = None, samples: int = 5) -> DataFrame:
    """Count, top score, best rank and first few leads of each primary family; leads without one last.

    With ``family``, leads that have it as a secondary are counted under it.
    """
    shown = places.where(F.col("role") == "primary") if family is None else places.where(F.col("role").isin("primary", "secondary"))
    wanted = F.lit(0) if family is None else F.when(F.col("family") == family, 0).otherwise(1)
    mine = shown.groupBy("id").agg(F.min_by("family", F.struct(wanted, F.col("place"))).alias("lead_family"))
    if family is not None:  # leads without the family stay under their primary one
        primary = places.where("role = 'primary'").select("id", F.col("family").alias("_first"))
        mine = mine.join(primary, "id", "left").select("id", F.when(F.col("lead_family") == family, F.col("lead_family")).otherwise(F.col("_first")).alias("lead_family"))
    rows = leads.select("id", "score", "rank").join(mine, "id", "left")
    counts = rows.groupBy("lead_family").agg(F.count("*").alias("leads"), F.max("score").alias("top_score"), F.min("rank").alias("top_rank"))
    # only the first few leads of a family are ranked: Spark cuts them before the shuffle
    place = F.row_number().over(Window.partitionBy("lead_family").orderBy("rank", "id"))
    firsts = rows.select("lead_family", "id", "rank").withColumn("_k", place).where(F.col("_k") <= samples)
    firsts = firsts.groupBy(F.col("lead_family").alias("_family")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "id"))), lambda x: x["id"]).alias("sample_ids"))
    out = counts.join(firsts, F.col("lead_family").eqNullSafe(F.col("_family"))).drop("_family")
    return out.orderBy(F.col("lead_family").isNull(), F.desc("leads"), "top_rank", "lead_family")


def distribution(leads: DataFrame, places: DataFrame) -> DataFrame:
    """Per family: leads that have it as primary, as secondary, or at all, and the share of the primaries in percent."""
    total = leads.agg(F.count("*").alias("total"))
    roles = leads.select("id").join(places.where("role != 'other'").select("id", "family", "role"), "id")
    n = roles.groupBy("family").agg(F.count_if(F.col("role") == "primary").alias("primary_leads"), F.count_if(F.col("role") == "secondary").alias("secondary_leads"), F.count("*").alias("any_leads"))
    return n.join(F.broadcast(total)).withColumn("primary_pct", F.bround(100 * F.col("primary_leads") / F.col("total"), 2)).drop("total")


def assignment_counts(leads: DataFrame, places: DataFrame) -> DataFrame:
    """One row: leads, those without a family, and those with more than one."""
    n = places.where("role != 'other'").groupBy("id").agg(F.count("*").alias("n"))
    return leads.select("id").join(n, "id", "left").agg(F.count("*").alias("leads"), F.count_if(F.col("n").isNull()).alias("unassigned"), F.count_if(F.col("n") > 1).alias("ambiguous"))


def concentration(leads: DataFrame, places: DataFrame, tops: tuple[int, ...] = (10, 50), collapse: float = 0.5) -> DataFrame:
    """Per head of the ranking: the most frequent primary family, its share, and whether it outweighs the rest."""
    first = places.where("role = 'primary'").select("id", "family")
    rows = leads.select("id", "rank").join(first, "id", "left").withColumn("top", F.explode(F.array(*map(F.lit, tops)))).where("rank <= top")
    n = rows.groupBy("top", "family").agg(F.count("*").alias("n"))
    out = n.groupBy("top").agg(F.sum("n").alias("leads"), F.max_by("family", F.when(F.col("family").isNotNull(), F.struct("n", "family"))).alias("family"), F.max(F.when(F.col("family").isNotNull(), F.col("n"))).alias("most"))
    share = F.bround(F.coalesce(F.col("most"), F.lit(0)) / F.col("leads"), 4)
    return out.select("top", "leads", "family", share.alias("share"), (share > collapse).alias("collapsed"))


def matches_family(places: DataFrame, family: str) -> DataFrame:
    """(id): leads that have the family as their primary or as a secondary one."""
    return places.where((F.col("family") == family) & F.col("role").isin("primary", "secondary")).select("id").distinct()

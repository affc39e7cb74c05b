"""Version 3 of the lead score: relevance, corroboration, traceability and context minus noise.

Everything is computed inside the row of an event, on its arrays (``clauses``, ``keywords``, ``links``,
``pairs``), so scoring needs no shuffle. Null arrays count as empty.

* ``clauses``  array<struct<pack, rule, weight, ...>>, in stored order
* ``keywords`` array<string> of ``pack:rule``
* ``links``    array<struct<lane, key>>: the clusters that hold the event, pairs left out
* ``pairs``    array<struct<k1, k2>>: keyword pairs of the event; ``pair_bonus`` is their bonus
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import SUPPRESSORS, tiered_sum

# Fixed values.
STARTER = "sam_procurement_starter"
LORE_RULES = ("explicit_uap_lore_noise_terms", "uap_lore_with_generic_secrecy_noise")
ROUTINE_RULES = (
    "nsn_line_item_commodity_noise",
    "nsn_part_number_quantity_noise",
    "medical_clinical_procurement_noise",
    "event_hospitality_admin_noise",
    "admin_facility_ops_noise",
    "generic_lab_supply_noise",
    "security_training_noise",
    "generic_facility_maintenance_noise",
    "generic_university_outreach_noise",
    "generic_medical_clinical_noise",
)
LINK_POINTS = {"same_doc_id": 2, "same_contract_id": 2, "same_award_id": 2, "same_entity": 1, "same_uei": 1}
CANDIDATE_LANE = "sam_usaspending_candidate_join"
STRUCTURAL_LANES = ("same_agency", "same_psc", "same_naics", "same_place_region", "same_sam_naics")
KEYWORD_POINTS = {"proxy": 2, "dod": 1, "starter": 1, "context": 1}

NONE = "array<struct<pack:string,rule:string,bucket:string,kind:string,weight:int>>"


@dataclass(frozen=True)
class Hint:
    """A classification tag: found by rule keys or by patterns in the lower-case text; a penalty makes it routine."""

    tag: str
    penalty: int = 0
    rule_keys: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Context:
    """Which handles an event has: boolean columns (default: it has none)."""

    has: dict[str, Column] = field(default_factory=dict)

    def flag(self, name: str) -> Column:
        return F.coalesce(self.has.get(name, F.lit(False)), F.lit(False))

    def points(self, **worth: int) -> Column:
        return sum((F.when(self.flag(n), w).otherwise(0) for n, w in worth.items()), F.lit(0))


def bucket(pack: Column, with_context: Column | bool = True) -> Column:
    """suppressor, proxy, dod, starter, context or neutral; the last two kinds of context need ``with_context``."""
    p = F.lower(F.trim(F.coalesce(pack, F.lit(""))))
    wide = F.lit(with_context) if isinstance(with_context, bool) else with_context
    return F.when(p == "", "neutral").when(p.isin(*SUPPRESSORS), "suppressor").when(p.startswith("sam_proxy_"), "proxy").when(p.startswith("sam_dod_"), "dod").when(~wide, "neutral").when(p == STARTER, "starter").otherwise("context")


def magnitude(kind: Column, weight: Column) -> Column:
    """Points of a clause by its bucket and the size of its weight (two at most)."""
    m = F.least(F.abs(weight), F.lit(2))
    return F.when(kind == "proxy", 4 + m).when(kind == "dod", 3 + m).when(kind == "context", 2 + F.least(m, F.lit(1))).when(kind == "starter", F.when(m >= 2, 2).otherwise(1)).otherwise(0)


def _named(pack: Column, rule: Column, b: Column, kind: str, weight: Column) -> Column:
    return F.struct(F.lower(F.trim(F.coalesce(pack, F.lit("")))).alias("pack"), F.lower(F.trim(rule)).alias("rule"), b.alias("bucket"), F.lit(kind).alias("kind"), weight.cast("int").alias("weight"))


def _of_clause(c: Column) -> Column:
    return _named(c["pack"], F.coalesce(c["rule"], F.lit("")), bucket(c["pack"]), "clause", F.coalesce(c["weight"].cast("int"), F.lit(0)))


def _of_keyword(k: Column) -> Column:
    parts = F.split(k, ":", 2)
    rule = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    return _named(parts[0], rule, bucket(parts[0], F.trim(rule) != ""), "keyword", F.lit(0))


def _pointed(s: Column) -> Column:
    """A named signal with its points and its penalty."""
    b, clause, lore = s["bucket"], s["kind"] == "clause", s["rule"].isin(*LORE_RULES)
    size = magnitude(b, s["weight"])
    points = F.when(clause, size).when(b == "proxy", KEYWORD_POINTS["proxy"]).when(b == "suppressor", 0).otherwise(1)
    penalty = F.when(b == "suppressor", F.when(lore, 4).otherwise(3) + F.when(clause, F.when(lore, 2).otherwise(1)).otherwise(0)).when(clause & (s["weight"] < 0), F.greatest(size, F.lit(1))).otherwise(0)
    return _signal(s["pack"], s["rule"], b, s["kind"], points, penalty)


def _signal(pack: Column, rule: Column, b: Column, kind: Column, points: Column, penalty: Column) -> Column:
    return F.struct(F.concat_ws(":", pack, rule).alias("key"), pack.alias("pack"), b.alias("bucket"), kind.alias("kind"), points.cast("int").alias("points"), penalty.cast("int").alias("penalty"), rule.isin(*ROUTINE_RULES).alias("routine"))


def _first_of_key(signals: str) -> Column:
    keys = F.transform(signals, lambda s: s["key"])
    return F.filter(signals, lambda s, i: F.array_position(keys, s["key"]) == i + 1)


def _points(of: str, kind: str, *buckets: str) -> Column:
    return F.transform(F.filter(of, lambda s: (s["kind"] == kind) & s["bucket"].isin(*buckets)), lambda s: s["points"])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _distinct(of: str, part: str, *buckets: str) -> Column:
    return F.size(F.array_distinct(F.transform(F.filter(of, lambda s: s["bucket"].isin(*buckets)), lambda s: s[part])))


def _above(n: Column, free: int, most: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), n - free))


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed once: a generator of one row, which keeps the optimizer from repeating their expressions above it."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def signals(df: DataFrame) -> DataFrame:
    """``df`` with ``_pos`` and ``_neg``: its positive and its suppressing signals, each rule once.

    Clauses come before keywords; a keyword whose rule a clause suppresses doesn't count.
    """
    every = F.concat(F.coalesce(F.transform("clauses", _of_clause), F.array().cast(NONE)), F.coalesce(F.transform("keywords", _of_keyword), F.array().cast(NONE)))
    out = df.withColumn("_named", F.filter(every, lambda s: s["bucket"] != "neutral"))
    out = out.withColumn("_all", F.transform("_named", _pointed)).drop("_named")
    out = out.withColumn("_neg", F.filter("_all", lambda s: s["penalty"] > 0)).withColumn("_neg", _first_of_key("_neg"))
    suppressed = F.transform("_neg", lambda s: s["key"])
    out = out.withColumn("_pos", F.filter("_all", lambda s: (s["penalty"] == 0) & ~((s["kind"] == "keyword") & F.array_contains(suppressed, s["key"]))))
    return settled(out.withColumn("_pos", _first_of_key("_pos")).drop("_all"))


def ontology_parts(df: DataFrame) -> DataFrame:
    """Adds ``proxy_relevance``, ``starter_context`` and ``other_context`` to rows with ``_pos``."""
    strong, zero = ("proxy", "dod"), F.lit(0)
    clause, word = (lambda *b: _points("_pos", "clause", *b)), (lambda *b: _total(_points("_pos", "keyword", *b)))
    relevance = tiered_sum(clause(*strong), 4, 0.5) + word(*strong) + _above(_distinct("_pos", "pack", *strong), 1, 4) + _above(_distinct("_pos", "key", *strong), 2, 2)
    starter = tiered_sum(clause("starter"), 2, 0.25) + word("starter")
    other = tiered_sum(clause("context"), 2, 0.5) + word("context") + _above(_distinct("_pos", "pack", "context"), 1, 2)
    return df.withColumns({"proxy_relevance": F.greatest(zero, F.least(F.lit(24), relevance)), "starter_context": F.least(F.lit(2), starter), "other_context": F.least(F.lit(3), other)})


def _families_of(pack: Column, families: dict[str, tuple[str, ...]]) -> Column:
    """The families of a pack; ``families`` is a small configuration."""
    none = F.array().cast("array<string>")
    if not families:
        return none
    known = F.create_map(*[x for k, v in families.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(known, pack), none)


def pair_caps(df: DataFrame, families: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Adds ``_caps``: (cap, labels, families) of each pair that counts, and ``starter_only_pairs``.

    A suppressed keyword drops its pair. Pairs of starter and context packs are worth 1; pairs with a proxy
    or defence pack 3, one more for a companion pack and one for a shared family, one less with a starter.
    """
    families = families or {}

    def named(p: Column) -> Column:
        packs = [F.lower(F.trim(F.split(p[k], ":", 2)[0])) for k in ("k1", "k2")]
        kinds = [bucket(x, F.contains(p[k], F.lit(":"))) for x, k in zip(packs, ("k1", "k2"))]
        return F.struct(F.array(*kinds).alias("kinds"), (packs[0] != packs[1]).alias("apart"), F.array_intersect(*[_families_of(x, families) for x in packs]).alias("shared"), F.array_union(*[_families_of(x, families) for x in packs]).alias("joined"))

    def sorted_out(n: Column) -> Column:
        has = lambda b: F.array_contains(n["kinds"], b)
        two = F.forall(n["kinds"], lambda b: b.isin("proxy", "dod")) & n["apart"]
        return F.struct(has("suppressor").alias("dropped"), (has("proxy") | has("dod")).alias("strong"), (has("proxy") & has("dod")).alias("both"), has("starter").alias("starter"), (has("starter") | has("context")).alias("light"), two.alias("two"), (F.size(n["shared"]) > 0).alias("close"), n["shared"].alias("shared"), n["joined"].alias("joined"))

    def judged(j: Column) -> Column:
        light, strong = ~j["strong"] & j["light"], j["strong"]
        cap = F.when(j["dropped"], 0).when(light, 1).when(strong, 3 + F.when(j["both"] | j["two"], 1).otherwise(0) + F.when(j["close"], 1).otherwise(0) - F.when(j["starter"], 1).otherwise(0)).otherwise(0)
        labels = F.array_compact(F.array(F.when(light, "starter_only"), F.when(strong, "proxy_pair"), F.when(j["both"], "proxy_dod_companion"), F.when(j["two"] & ~j["both"], "multi_pack"), F.when(strong & j["close"], "family_relevant"), F.when(strong & j["starter"], "starter_mixed")))
        nothing = F.array().cast("array<string>")
        told = F.when(light, nothing).when(j["close"], j["shared"]).when(F.size(j["joined"]) == 1, j["joined"]).otherwise(nothing)
        return F.struct(cap.cast("int").alias("cap"), labels.alias("labels"), told.alias("families"))

    none = F.array().cast("array<struct<cap:int,labels:array<string>,families:array<string>>>")
    out = df.withColumn("_j", F.transform("pairs", named)).withColumn("_j", F.transform("_j", sorted_out))
    caps = F.filter(F.coalesce(F.transform("_j", judged), none), lambda c: c["cap"] > 0)
    return out.withColumn("_caps", caps).drop("_j").withColumn("starter_only_pairs", F.size(F.filter("_caps", lambda c: F.array_contains(c["labels"], "starter_only"))))


def corroboration(df: DataFrame, families: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Adds ``corroboration``, ``pair_bonus_applied``, ``candidate_links``, ``family_bonus`` and lane counts."""
    families = families or {}
    gate = (F.col("proxy_relevance") > 0) | (F.size("_caps") > 0)

    def worth(link: Column) -> Column:
        pack = F.substring_index(link["key"], ":", 1)
        b = bucket(pack, F.contains(link["key"], F.lit(":")))
        word = F.when(b.isin("proxy", "dod"), 2).when(b == "context", 1).otherwise(0)
        linked = sum((F.when(link["lane"] == lane, p).otherwise(0) for lane, p in LINK_POINTS.items()), F.when(link["lane"] == CANDIDATE_LANE, F.when(F.col("proxy_relevance") >= 8, 3).otherwise(2)).otherwise(0))
        points = F.when(link["lane"] == "same_keyword", word).when(gate, linked).otherwise(0)
        return F.struct(link["lane"].alias("lane"), points.cast("int").alias("points"))

    none = F.array().cast("array<struct<lane:string,points:int>>")
    out = df.withColumn("_links", F.filter(F.coalesce(F.transform("links", worth), none), lambda x: x["points"] > 0))
    lanes = F.array_distinct(F.transform("_links", lambda x: x["lane"]))
    out = out.withColumns({"link_lanes": F.size(lanes), "candidate_links": F.size(F.filter("_links", lambda x: x["lane"] == CANDIDATE_LANE)), "structural_lanes": F.coalesce(F.size(F.array_distinct(F.filter(F.transform("links", lambda x: x["lane"]), lambda x: x.isin(*STRUCTURAL_LANES)))), F.lit(0))})
    out = out.withColumn("structural_lanes", F.greatest("structural_lanes", F.lit(0)))

    strong = F.filter("_pos", lambda s: s["bucket"].isin("proxy", "dod"))
    backed = F.flatten(F.transform("_caps", lambda c: c["families"]))
    hits = F.flatten(F.transform(strong, lambda s: _families_of(s["pack"], families)))
    out = settled(out.withColumns({"_hits": hits, "_backed": backed}))
    per_family = lambda f: F.size(F.filter("_hits", lambda h: h == f))
    bonus = lambda f: F.least(F.lit(2), F.greatest(F.lit(0), per_family(f) - 1)) + F.when(F.array_contains("_backed", f), 1).otherwise(0) + F.when((per_family(f) >= 2) & (F.col("link_lanes") > 0), 1).otherwise(0)
    ranked = F.array_sort(F.transform(F.array_distinct("_hits"), lambda f: F.struct((-bonus(f)).alias("less"), (-per_family(f)).alias("fewer"), f.alias("family"))))
    best = F.try_element_at(ranked, F.lit(1))
    out = out.withColumns({"family_bonus": F.coalesce(-best["less"], F.lit(0)), "best_family": best["family"]})

    cross = F.least(F.lit(2), F.col("link_lanes"))
    ordered = F.sort_array(F.transform("_caps", lambda c: c["cap"]), asc=False)
    first, second = (F.coalesce(F.try_element_at(ordered, F.lit(k)), F.lit(0)) for k in (1, 2))
    cap = first + F.when(second >= 3, 1).otherwise(0)
    cap = F.least(F.lit(8), cap + F.when(cap >= 2, cross).otherwise(0))
    out = out.withColumn("pair_bonus_applied", F.when(F.size("_caps") > 0, F.greatest(F.lit(0), F.least(F.col("pair_bonus").cast("int"), cap))).otherwise(0))
    extra = F.array(cross, F.col("family_bonus"), F.col("pair_bonus_applied"))
    lanes_in_all = F.col("link_lanes") + F.when(F.col("pair_bonus_applied") > 0, 1).otherwise(0)
    total = tiered_sum(F.concat(F.transform("_links", lambda x: x["points"]), extra), 5, 0.5) + _above(lanes_in_all, 1, 2)
    return out.withColumn("corroboration", F.least(F.lit(13), total)).drop("_hits", "_backed")


def hint_tags(text: Column, hints: tuple[Hint, ...]) -> Column:
    """The tags of ``hints`` that an event's rules or its text call for, in the hints' order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    keys = F.concat(F.transform("_pos", lambda s: s["key"]), F.transform("_neg", lambda s: s["key"]))

    def found(h: Hint) -> Column:
        by_rule = F.arrays_overlap(keys, F.array(*map(F.lit, h.rule_keys))) if h.rule_keys else F.lit(False)
        for p in h.patterns:
            by_rule = by_rule | low.rlike(p)
        return F.when(by_rule, h.tag)

    return F.array_compact(F.array(*map(found, hints))) if hints else F.array().cast("array<string>")


def routine_penalty(tags: str, hints: tuple[Hint, ...], most: int = 12) -> Column:
    return F.least(F.lit(most), sum((F.when(F.array_contains(tags, h.tag), h.penalty).otherwise(0) for h in hints), F.lit(0)))


def supports_metadata(source: Column) -> Column:
    """Only one feed's metadata raises scores: its name is ``samgov`` without punctuation."""
    return F.lower(F.regexp_replace(F.coalesce(source, F.lit("")), "[^A-Za-z0-9]", "")) == "samgov"


def score_v3(df: DataFrame, context: Context | None = None, text: Column | None = None, metadata: Column | None = None, hints: tuple[Hint, ...] = (), families: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``df`` with the version 3 parts, ``score``, ``ranking_tier`` and ``tags``.

    ``context`` names the handles id, url, agency, time, entity, vendor (traceability) and codes, place,
    type, handle (structure); those of the second kind, and vendor, count only where ``metadata`` holds.
    """
    c, meta = context or Context(), F.coalesce(metadata if metadata is not None else F.lit(True), F.lit(False))
    out = settled(corroboration(settled(pair_caps(ontology_parts(signals(df)), families)), families))
    named = c.flag("entity") | (meta & c.flag("vendor"))
    out = out.withColumns({
        "tags": hint_tags(text if text is not None else F.lit(""), hints),
        "_vendor": meta & c.flag("vendor"),
        "_trace": F.least(F.lit(6), c.points(id=2, url=1, agency=1, time=1) + F.when(named, 1).otherwise(0)),
        "_structure": F.least(F.lit(5), F.col("starter_context") + F.col("other_context") + F.when(meta, c.points(codes=1, place=1, type=1, handle=1)).otherwise(0) + F.least(F.lit(2), F.col("structural_lanes"))),
    })
    proxy, corr = F.col("proxy_relevance"), F.col("corroboration")
    ontology = F.least(F.lit(4), F.col("starter_context") + F.col("other_context"))
    bare, weak = (proxy <= 0) & (corr <= 0), (proxy < 8) & (corr < 5)
    some_ontology = F.when(ontology > 0, 1).otherwise(0)
    narrow = F.when((F.col("other_context") > 0) & ~((F.col("starter_only_pairs") > 0) & (F.col("link_lanes") == 0)), 3).otherwise(2)
    out = out.withColumns({
        "investigability": F.when(bare, F.least(F.lit(2), F.col("_trace"))).when(weak, F.least(F.when(F.col("_vendor"), 5).otherwise(4), F.col("_trace"))).otherwise(F.col("_trace")),
        "structural": F.when(bare, F.least(1 + some_ontology, F.col("_structure"))).when(weak, F.least(narrow, F.col("_structure"))).otherwise(F.col("_structure")),
    })
    out = settled(out)
    routine_rules = F.size(F.array_distinct(F.transform(F.filter("_neg", lambda s: s["routine"]), lambda s: F.substring_index(s["key"], ":", -1))))
    loose = (proxy < 8) & (corr < 4)
    surcharge = F.least(F.lit(4), 2 * routine_rules) + F.when((routine_rules > 0) & ((F.col("starter_only_pairs") > 0) | (F.col("starter_context") > 0)), 1).otherwise(0)
    noise = tiered_sum(F.transform("_neg", lambda s: s["penalty"]), 3, 0.5) + F.when((F.size("_neg") > 0) & loose, 4).otherwise(0) + surcharge + F.when(loose, routine_penalty("tags", hints)).otherwise(0)
    backed = (F.col("pair_bonus_applied") > 0) | (F.col("candidate_links") > 0)
    gate = F.when((proxy <= 0) & ~backed, F.greatest(F.lit(0), F.col("investigability") + F.col("structural") - 2 - F.least(ontology, F.lit(1)))).otherwise(0)
    tier = F.when((proxy <= 0) & ~backed, "context_only").when((proxy >= 8) & backed, "highest").when((proxy >= 6) | backed | (corr >= 4), "review").when(proxy > 0, "candidate").otherwise("background")
    out = out.withColumns({"noise_penalty": F.least(F.lit(20), noise), "gate_penalty": gate, "ranking_tier": tier})
    out = out.withColumn("score", proxy + F.col("investigability") + corr + F.col("structural") - F.col("noise_penalty") - F.col("gate_penalty"))
    return settled(out.withColumns({"top_positives": top_signals("_pos", "points", 8), "top_suppressors": top_signals("_neg", "penalty", 8)})).drop("_pos", "_neg", "_caps", "_links", "_vendor", "_trace", "_structure")


def top_signals(of: str, by: str, n: int) -> Column:
    """The ``n`` strongest signals as (points, key), strongest first, then by key."""
    return F.transform(F.slice(F.array_sort(F.transform(of, lambda s: F.struct((-s[by]).alias("less"), s["key"].alias("key")))), 1, n), lambda s: F.struct((-s["less"]).alias("points"), s["key"].alias("key")))

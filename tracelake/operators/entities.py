"""Entity resolution: events that share an identifier belong to one organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import clean_code, clean_text
from .terms import contained

#: Identifiers from the strongest to the weakest (fixed values).
IDENTIFIERS = ("uei", "duns", "cage", "recipient_id", "parent_code", "name")
#: The source whose records name the buying organisation by a parent path where they have no recipient (fixed value).
NOTICES = "SAM.gov"


def identity(df: DataFrame, uei="recipient_uei", duns="recipient_duns", cage="recipient_cage", recipient_id="recipient_id", name="recipient_name", parent_code="parent_path_code", parent_name="parent_path_name", kind="organization_type", source="source") -> DataFrame:
    """(id, uei, duns, cage, recipient_id, parent_code, name, organization_type, display) from the columns of these names that ``df`` has.

    Notices take the parent path's name and code where they have no recipient's name and id; only they have a parent-path code and
    an organisation type. ``display`` is the name, else the first identifier with its kind (``SAM:`` or, in other sources, ``RID:`` for a recipient id).
    """
    get = lambda c, f: f(F.col(c)) if c in df.columns else F.lit(None).cast("string")
    notice = F.coalesce(F.col(source) == NOTICES, F.lit(False)) if source in df.columns else F.lit(False)
    code, path, own = F.when(notice, get(parent_code, clean_code)), F.when(notice, get(parent_name, clean_text)), get(recipient_id, clean_text)
    out = df.select("id", get(uei, clean_code).alias("uei"), get(duns, clean_code).alias("duns"), get(cage, clean_code).alias("cage"), F.coalesce(own, code).alias("recipient_id"), code.alias("parent_code"), F.coalesce(get(name, clean_text), path).alias("name"), F.when(notice, get(kind, clean_text)).alias("organization_type"), notice.alias("_notice"))
    named = [F.concat(F.lit(f"{c.upper()}:"), c) for c in ("uei", "cage", "duns")]
    return out.withColumn("display", F.coalesce("name", *named, F.concat(F.when(F.col("_notice"), "SAM:").otherwise("RID:"), "recipient_id"))).drop("_notice")


def identifier_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, priority, v): every identifier of every row, in one pass."""
    listed = F.array(*[F.struct(F.lit(k).alias("priority"), F.lower(c).alias("v")) for k, c in enumerate(IDENTIFIERS)])
    return df.select(key, F.explode(listed).alias("i")).select(key, "i.priority", "i.v").where("v is not null")


def match_existing(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, entity_id): the entity that an event matches by its strongest identifier, lowest id first."""
    known = identifier_rows(entities, "entity_id").groupBy("priority", "v").agg(F.min("entity_id").alias("entity_id"))
    hit = identifier_rows(events, "id").join(known, ["priority", "v"])
    return hit.groupBy("id").agg(F.min(F.struct("priority", "entity_id")).alias("m")).select("id", "m.entity_id")


def absorbed(entities: DataFrame, events: DataFrame, matches: DataFrame) -> DataFrame:
    """``entities`` with missing identifiers filled from the events matched to them, earliest event first."""
    columns = IDENTIFIERS[:-1]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"_{c}") for c in columns]
    found = events.join(matches, "id").groupBy("entity_id").agg(*first)
    return entities.join(found, "entity_id", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select(*entities.columns)


def by_term(events: DataFrame, text: Column, terms: DataFrame) -> DataFrame:
    """(id, entity_id): the least entity one of whose terms (entity_id, term) the text contains, ignoring case; see ``terms.contained``."""
    wanted = terms.select(F.col("entity_id").alias("value"), F.trim("term").alias("term"))
    return events.select("id", F.array_min(contained(text, wanted)).alias("entity_id")).where("entity_id IS NOT NULL")


def shared_identifier_groups(events: DataFrame, write, rounds: int = 40) -> DataFrame:
    """(id, entity_id): components of events over shared strong identifiers; entity_id is the least event id.

    Events hook to the least event of each identifier (a star, not all pairs), labels then spread by
    minimum until nothing changes. ``write`` stores a table in shared storage and reads it back.
    """
    keys = None
    for c in IDENTIFIERS[:-1]:
        part = events.select("id", F.concat(F.lit(f"{c}:"), F.lower(c)).alias("key")).where("key is not null")
        keys = part if keys is None else keys.union(part)
    keys = write(keys.distinct())
    label = write(events.select("id", F.col("id").alias("entity_id")))
    for _ in range(rounds):
        by_key = keys.join(label, "id").groupBy("key").agg(F.min("entity_id").alias("m"))
        by_event = keys.join(by_key, "key").groupBy("id").agg(F.min("m").alias("m"))
        step = label.join(by_event, "id", "left").select("id", F.least("entity_id", "m").alias("next"), "entity_id")
        jump = step.join(step.select(F.col("id").alias("next"), F.col("next").alias("far")), "next", "left")
        step = write(jump.select("id", F.least("next", "far").alias("next"), "entity_id"))
        if not step.where("next != entity_id").limit(1).count():
            return label
        label = step.select("id", F.col("next").alias("entity_id"))
    raise RuntimeError("entity groups haven't settled")

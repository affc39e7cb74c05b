"""Scalar normalisation of procurement records, as Column -> Column functions."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as missing (fixed values).
NULL_LIKE = ("", "null", "none", "n/a", "nan")
#: The blanks of Unicode (category Zs).
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Words that a company name is compared without (fixed values).
NAME_STOP_WORDS = ("A", "AN", "AND", "CO", "COMPANY", "CORP", "CORPORATION", "FEDERAL", "INC", "INCORPORATED", "L", "LC", "LLC", "LLP", "LTD", "LP", "OF", "PC", "PLC", "SERVICE", "SERVICES", "SYSTEM", "SYSTEMS", "TECHNOLOGIES", "TECHNOLOGY", "THE")


def is_blank(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*NULL_LIKE)


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; null-like texts are null."""
    tidy = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(~is_blank(tidy), tidy)


def clean_code(c: Column) -> Column:
    return F.upper(clean_text(c))


def clean_label(c: Column) -> Column:
    return F.lower(clean_text(c))


def naics_code(c: Column) -> Column:
    code = F.upper(F.regexp_replace(clean_text(c), "[^A-Za-z0-9]", ""))
    return F.when(code != "", code)


def first_present(*cs: Column) -> Column:
    return F.coalesce(*map(clean_text, cs))


def company_key(c: Column) -> Column:
    """Upper-case words without stop words (all words if nothing is left)."""
    words = F.filter(F.split(F.regexp_replace(F.replace(F.upper(c), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " "), " "), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(*NAME_STOP_WORDS))
    name = F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")
    return F.when(~is_blank(c) & (name != ""), name)


def identifier_token(c: Column) -> Column:
    token = F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    return F.when(~is_blank(c) & (token != ""), token)


def contract_family(token: Column) -> Column:
    """The root of a token of eight or more characters without a modification suffix (six or more left)."""
    # the pattern is a fixed value
    root = F.regexp_extract(token, r"^(.*?)(?:MOD\d{1,4}|P\d{1,4}|M\d{1,4}|A\d{1,4})$", 1)
    return F.when((F.length(token) >= 8) & (F.length(root) >= 6), root)


def key_text(c: Column, upper: bool = True) -> Column:
    """A text as a part of a correlation key: no blanks around it, no bars, one case, long ones hashed.

    Lower case is taken letter by letter, so that a letter has one form wherever it stands (a capital sigma at a word's end, a dotted capital I).
    """
    t = F.replace(F.btrim(c, F.lit(SPACES)), F.lit("|"), F.lit("/"))
    t = F.upper(t) if upper else F.lower(F.translate(t, "\u03a3\u0130", "\u03c3i"))
    return F.when(F.length(t) > 120, F.concat(F.lit("sha1:"), F.substring(F.sha1(t), 1, 20))).otherwise(t)


def key_token(c: Column, upper: bool = True) -> Column:
    """``key_text`` of a text that isn't missing."""
    return F.when(~is_blank(F.btrim(c, F.lit(SPACES))), key_text(c, upper))


def keyword(c: Column) -> Column:
    return F.lower(F.replace(F.trim(c), F.lit("|"), F.lit("/")))


def keyword_pack(c: Column) -> Column:
    return F.substring_index(keyword(c), ":", 1)


def is_noise_keyword(c: Column) -> Column:
    return (keyword(c) == "") | keyword_pack(c).rlike("noise|suppress")


def humanize(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("_"), F.lit(" ")), F.lit(":"), F.lit(": "))


def place_label(state: Column, country: Column, text: Column) -> Column:
    both = F.when(~is_blank(state) & ~is_blank(country), F.concat_ws(", ", state, country))
    return F.coalesce(both, clean_text(state), clean_text(country), clean_text(text))


def agency_label(name: Column, code: Column) -> Column:
    return F.when(~is_blank(name) & ~is_blank(code), F.concat(name, F.lit(" ("), code, F.lit(")"))).otherwise(F.coalesce(clean_text(name), clean_text(code)))


def bounded_text(c: Column, most: int = 65536) -> Column:
    """At most about ``most`` characters: a longer text keeps its head and its tail around a note of what is missing."""
    note = F.concat(F.lit("...<truncated_json:"), (F.length(c) - most).cast("string"), F.lit("chars>..."))
    room = F.lit(most) - F.length(note)
    head = F.floor(room / 2).cast("int")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, F.lit(1), head), note, F.right(c, (room - head).cast("int"))))


#: Bounds of a raw record's JSON (fixed values): levels, members of an object or list, characters of a string.
LEVELS, MEMBERS, CHARACTERS = 6, 64, 2048
#: No JSON of fewer characters can break a bound.
SHORT = 2 * MEMBERS


def _cut(text: str, most: int, note: str) -> str:
    head = (most - len(note)) // 2
    return text[:head] + note + text[len(text) - (most - len(note) - head) :]


def _bounded(value: object, level: int) -> object:
    if level >= LEVELS:
        return "__depth_truncated__"
    half = MEMBERS // 2
    if isinstance(value, dict):
        keys = sorted(value)
        kept = keys if len(keys) <= MEMBERS else keys[:half] + keys[-half:]
        out = {k: _bounded(value[k], level + 1) for k in kept}
        return out if len(kept) == len(keys) else out | {"__truncated_keys__": len(keys) - len(kept)}
    if isinstance(value, list):
        if len(value) <= MEMBERS:
            return [_bounded(x, level + 1) for x in value]
        return [*(_bounded(x, level + 1) for x in value[:half]), f"__truncated_items__:{len(value) - MEMBERS}", *(_bounded(x, level + 1) for x in value[-half:])]
    if isinstance(value, str) and len(value) > CHARACTERS:
        return _cut(value, CHARACTERS, f"...<truncated:{len(value) - CHARACTERS}chars>...")
    return value


@F.arrow_udf(T.StringType())
def _bounded_udf(texts: pa.Array) -> pa.Array:
    """Bounded JSON of long JSON texts; texts that aren't JSON stay."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_bounded(json.loads(text), 0), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return text

    return pa.array([one(t) for t in texts.to_pylist()], pa.string())


def bounded_json(c: Column, most: int = 65536) -> Column:
    """JSON text with sorted keys and bounded levels, members, strings and length.

    Keys are sorted by way of VARIANT, whose objects keep them so; only texts long enough to break a bound go to Python.
    """
    text = F.coalesce(F.to_json(F.try_parse_json(c)), c)
    long = F.length(c) > SHORT
    return bounded_text(F.when(long, _bounded_udf(F.when(long, c))).otherwise(text), most)


def parsed_date(c: Column) -> Column:
    """ISO, month/day/year and compact dates; null for anything else."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss")], F.try_to_timestamp(c))


def event_time(occurred: Column, created: Column) -> Column:
    return F.coalesce(occurred, created)

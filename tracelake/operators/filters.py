"""Investigator filters and paged event queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_text(c: Column, text: str) -> Column:
    return F.lower(c).contains(text.lower())


def event_conditions(df: DataFrame, *, source=None, exclude_source=None, start=None, end=None, entity_id=None, has_entity=None, keyword=None, award_id=None, uei=None, agency=None, psc=None, naics=None, region=None, notice_type=None, min_amount=None, contract_id=None, document_id=None, notice_id=None, solicitation=None) -> Column:
    """The conjunction of all filters that are given; columns that ``df`` lacks can't be asked for."""
    conditions: list[Column] = []
    ask = conditions.append
    if source is not None:
        ask(F.col("source") == source)
    if exclude_source is not None:
        ask(F.col("source") != exclude_source)
    if start is not None:
        ask(F.col("occurred_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        ask(F.col("occurred_at") <= F.lit(end).cast("timestamp"))
    if entity_id is not None:
        ask(F.col("entity_id") == entity_id)
    if has_entity is not None:
        ask(F.col("entity_id").isNotNull() if has_entity else F.col("entity_id").isNull())
    if keyword is not None:
        ask(F.array_contains("keywords", keyword))
    if award_id is not None:
        ask((F.col("award_id") == award_id) | ((F.col("generated_unique_award_id") == award_id) if "generated_unique_award_id" in df.columns else F.lit(False)))
    if uei is not None:
        ask(F.upper("recipient_uei") == uei.upper())
    if agency is not None:
        codes = [F.upper(c) == agency.upper() for c in ("agency_code", "funding_agency_code", "office_code") if c in df.columns]
        names = [contains_text(F.col(c), agency) for c in ("agency_name", "funding_agency_name", "office_name") if c in df.columns]
        ask(reduce(lambda a, b: a | b, codes + names))
    if psc is not None:
        ask(contains_text(F.col("psc"), psc))
    if naics is not None:
        ask(contains_text(F.col("naics"), naics))
    if region is not None:
        parts = [p.strip().upper() for p in region.replace(":", ",").split(",") if p.strip()]
        state, country = F.upper("state"), F.upper("country")
        ask(((state == parts[0]) & (country == parts[1])) | ((state == parts[1]) & (country == parts[0])) if len(parts) == 2 else (state == parts[0]) | (country == parts[0]))
    if notice_type is not None:
        ask(F.lower("notice_type") == notice_type.lower())
    for value, names in ((contract_id, ("piid", "fain", "uri")), (document_id, ("document_id", "doc_id")), (notice_id, ("notice_id",)), (solicitation, ("solicitation_number",))):
        if value is not None:
            ask(reduce(lambda a, b: a | b, [F.col(n) == value for n in names if n in df.columns], F.lit(False)))
    if min_amount is not None:
        ask(F.col("amount") >= min_amount)
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def window(df: DataFrame, as_of: str, days: int, time: str = "occurred_at") -> DataFrame:
    """Events of the last ``days`` days before ``as_of`` (a literal: pushed to the scan)."""
    if days <= 0:
        raise ValueError("days must be positive")
    end = F.lit(as_of).cast("timestamp")
    return df.where((F.col(time) >= end - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(time) <= end))


SORTS = {"occurred_at": "occurred_at", "created_at": "created_at", "id": "id", "source": "source"}


def query_events(df: DataFrame, *, sort_by: str = "occurred_at", descending: bool = True, limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    """Filtered events, ordered with a unique tiebreak, one page of them."""
    c = F.lower("source") if sort_by == "source" else F.col(SORTS[sort_by])
    order = [c.desc_nulls_last(), F.col("id").desc()] if descending else [c.asc_nulls_first(), F.col("id").asc()]
    out = df.where(event_conditions(df, **filters)).orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def any_filter(**filters) -> bool:
    """Whether any event filter is asked for; counts shown to the user then are those of matching events."""
    return any(v is not None and v != "" for v in filters.values())


def legacy_events(df: DataFrame, *, source=None, start=None, end=None, text=None, column: str = "snippet") -> DataFrame:
    """The older listing: source, occurred range and a substring of the snippet."""
    rows = df if source is None else df.where(F.col("source") == source)
    rows = rows if start is None else rows.where(F.col("occurred_at") >= F.lit(start).cast("timestamp"))
    rows = rows if end is None else rows.where(F.col("occurred_at") <= F.lit(end).cast("timestamp"))
    return rows if text is None else rows.where(contains_text(F.col(column), text))


def clamped_window(posted: tuple[str | None, str | None], start: str | None, end: str | None) -> tuple[str | None, str | None]:
    """The later of the lower and the earlier of the upper bounds (ISO dates); without a posted window, as asked."""
    if None in posted:
        return start, end
    return max(x for x in (posted[0], start) if x), min(x for x in (posted[1], end) if x)


def posted_window(days: int | None = None, posted_from: str | None = None, posted_to: str | None = None, today: str | None = None) -> tuple[str, str]:
    """Inclusive ISO dates of a posted window: the last 1 to 365 (by default 30) days, or both ends given."""
    from datetime import date, timedelta

    if (posted_from is None) != (posted_to is None):
        raise ValueError("both ends of the window are needed")
    if posted_from is not None:
        if days is not None:
            raise ValueError("days and explicit ends exclude each other")
        if date.fromisoformat(posted_from) > date.fromisoformat(posted_to):
            raise ValueError("the window ends before it starts")
        return posted_from, posted_to
    if not 1 <= (days := 30 if days is None else days) <= 365:
        raise ValueError("days must be 1 to 365")
    last = date.fromisoformat(today) if today else date.today()
    return (last - timedelta(days=days)).isoformat(), last.isoformat()


def hard_filters(df: DataFrame, text: str, *, include_any: tuple[str, ...] = (), exclude_any: tuple[str, ...] = (), agency_like: str | None = None, agency: str = "agency_name", min_amount: float | None = None, amount: str = "amount") -> DataFrame:
    """Hunted rows that mention any wanted and no unwanted term (whole words), whose agency contains a text, and whose amount, if known, is enough."""
    from .tagging import term_hits

    rows = df
    if include_any:
        rows = rows.where(term_hits(F.col(text), list(include_any)) > 0)
    if exclude_any:
        rows = rows.where(term_hits(F.col(text), list(exclude_any)) == 0)
    if agency_like is not None:
        rows = rows.where(contains_text(F.coalesce(agency, F.lit("")), agency_like))
    return rows if min_amount is None else rows.where(F.col(amount).isNull() | (F.col(amount) >= min_amount))


def lead_conditions(df: DataFrame, as_of: str | None = None, since_days: int | None = None, created_from=None, created_to=None, **filters) -> Column:
    """Conditions of lead candidates, to be asked before a scan limit: those of events, and ranges of the creation and of recent time."""
    condition = event_conditions(df, **filters)
    if created_from is not None:
        condition = condition & (F.col("created_at") >= F.lit(created_from).cast("timestamp"))
    if created_to is not None:
        condition = condition & (F.col("created_at") <= F.lit(created_to).cast("timestamp"))
    if since_days is not None:
        condition = condition & (F.col("occurred_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(since_days)} DAYS"))
    return condition


def in_window(c: Column, start: str, end: str) -> Column:
    """Whether a time lies in the window; a time that isn't known doesn't."""
    return F.coalesce(c.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")), F.lit(False))

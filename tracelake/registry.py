"""All registered queries of the event-correlation engine and their SQL."""

from __future__ import annotations

from .plans import details as _details  # noqa: F401  (registers its queries)
from .plans import feeds as _feeds  # noqa: F401  (registers its queries)
from .plans import flows as _flows  # noqa: F401  (registers its queries)
from .plans import leads as _leads  # noqa: F401  (registers its queries)
from .plans import queries as q

FLAGSHIP = "cor12_same_agency"


def queries() -> dict:
    return {name: f for name, (f, _) in q.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in q.QUERIES.items() if sql}

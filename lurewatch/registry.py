"""All registered queries of the triage jobs, with their SQL."""

from __future__ import annotations

from lurewatch.jobs import byte_queries as _bytes  # noqa: F401 - adds its queries to the same tables
from lurewatch.jobs import more_queries as _more  # noqa: F401 - adds its queries to the same tables
from lurewatch.jobs import queries as _q


def queries() -> dict:
    return dict(_q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_q.ORACLES)

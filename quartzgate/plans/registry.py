"""All queries outside the corpus operators, with their DuckDB counterparts."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import judging, pools, records, relational, reports, routing, sampling, spans, statistics, stream  # noqa: E402,F401

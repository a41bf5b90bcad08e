"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from quartzgate.plans import registry
from quartzgate.sources.tables import NAMES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in NAMES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def table(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = table(df.select(*[f"`{c}`" for c in columns]).collect())
    if name in registry.ORACLES:
        rel = duck.sql(registry.ORACLES[name])
        assert sorted(rel.columns) == columns
        assert got == table(rel.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 32
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

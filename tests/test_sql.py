"""Every registered query with SQL agrees with DuckDB on the small tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from codestrata.catalog import registries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
CASES = [(name, r) for r in registries() for name in r.functions]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name,registry", CASES, ids=[c[0] for c in CASES])
def test_query(spark, duck, name, registry):
    got = registry.functions[name](spark, SF)
    data = got.collect()
    if name not in registry.sql:
        assert len(set(got.columns)) == len(got.columns)
        return
    want = duck.execute(registry.sql[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, data) == rows(names, want.fetchall())

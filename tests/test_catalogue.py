"""Queries against their SQL twins in DuckDB. CATALOGUE=all runs all of them, else every fifth."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lexmine.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(SQL) if os.environ.get("CATALOGUE") == "all" else sorted(SQL)[::5]


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    result = duck.execute(SQL[name])
    place = [d[0] for d in result.description]
    assert sorted(place) == columns
    assert got == sorted(repr(tuple(norm(r[place.index(c)]) for c in columns)) for r in result.fetchall())
    assert got


def test_names_carry_inventory_ids():
    assert all(n[:3] in {"src", "fil", "joi", "agg", "win", "srt", "set", "fun", "pip", "str"} for n in QUERIES)

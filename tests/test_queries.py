"""Registered queries against their SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from cohortaudit.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.ORACLE)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        files = f"{p}/*.parquet" if p.is_dir() else p
        con.sql(f"create view {p.stem} as select * from '{files}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    return str(v) if isinstance(v, int) else ("nan" if math.isnan(float(v)) else repr(round(float(v), 6) + 0.0))


def test_registry():
    assert len(registry.QUERIES) > 190
    assert set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(registry.ORACLE[name])
    assert sorted(found.columns) == columns
    doubles = {c for c, kind in df.dtypes if kind == "double"}
    norm = lambda r: tuple(plain(float(v) if c in doubles and v is not None else v) for c, v in zip(columns, r))
    at = [found.columns.index(c) for c in columns]
    assert sorted(norm(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()) == sorted(norm([r[i] for i in at]) for r in found.fetchall())

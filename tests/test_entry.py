"""Every registered query against its SQL in DuckDB on the smallest tables, and the driver contract."""

import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from geoloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted((tuple(map(plain, r)) for r in out.select(*columns).collect()), key=str)
    if name not in SQL:
        assert got
        return
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(QUERIES) <= set(queries)


def test_plans_push_down(spark, capsys):
    QUERIES["filter_exclude"](spark, SF).explain("formatted")
    assert re.search(r"PushedFilters: .*GreaterThan\(l_quantity,45.0\)", capsys.readouterr().out)
    QUERIES["select_columns"](spark, SF).explain()
    shown = capsys.readouterr().out
    assert "p_brand" not in shown
    QUERIES["spatial_join"](spark, SF).explain()
    shown = capsys.readouterr().out
    assert "CartesianProduct" not in shown
    assert "BroadcastNestedLoopJoin" not in shown

"""Every query against DuckDB on the smallest tables, and the plans that matter."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ndspark import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


def test_sql_for_every_query():
    assert set(q.QUERIES) == set(q.ORACLE) and set(q.QUERIES) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, name, tmp_path):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    q.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    want, have = con.sql(q.ORACLE[name]), con.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'")
    assert dict(zip(want.columns, map(str, want.types), strict=True)) == dict(zip(have.columns, map(str, have.types), strict=True))
    columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
    rows = lambda r: sorted(map(str, con.sql(f"SELECT {columns} FROM r").fetchall()))
    assert rows(want) == rows(have)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
def test_filters_reach_the_scan(spark):
    plan = q.QUERIES["filter_and"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,20.0)" in plan and "EqualTo(event_type,click)" in plan
    assert "props" not in plan.split("ReadSchema")[1][:200]

"""Every registered query outside llm against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from evidence_spark.plans import context, evidence, relational, retrieval, rules, spreadsheets, support

SF = "/root/testdata/sf0.001"
QUERIES = retrieval.QUERIES | relational.QUERIES | evidence.QUERIES | rules.QUERIES | support.QUERIES | spreadsheets.QUERIES | context.QUERIES
SQL = retrieval.SQL | relational.SQL | evidence.SQL | rules.SQL | support.SQL | spreadsheets.SQL | context.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 5) + 0.0 if not math.isnan(float(v)) else "nan"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_no_cartesian_product(spark):
    for name in ("retrieval_recall", "dense_topk", "table_lookup"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan

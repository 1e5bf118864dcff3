"""Every registered audit query against its SQL in DuckDB, on the smallest data."""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from failscope.plans import registry
from failscope.sources.views import TABLES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if v is None or str(v) in ("<NA>", "nan", "NaT"):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}" if v and not math.isinf(v) else "0"
    return str(v)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def results(spark):
    """Of every query with SQL both results or the error, some at a time: most of a run on small data is planning."""
    names, sql, known = sorted(registry.oracle_sql()), registry.oracle_sql(), registry.queries()

    def one(name):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        try:
            return known[name](spark, SF).toPandas(), con.execute(sql[name]).fetchdf()
        except Exception as e:
            return e

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(names, pool.map(one, names)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(results, name):
    if isinstance(results[name], Exception):
        raise results[name]
    got, want = results[name]
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship_and_plans(spark):
    out = registry.flagship(spark, SF)
    assert out.columns == ["module", "feature", "metric", "value", "severity"] and out.count() >= 6
    plan = registry.queries()["ev6_threshold_table"](spark, SF)._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan

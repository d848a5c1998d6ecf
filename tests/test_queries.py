"""Every query of the library's own operators against its SQL at the smallest scale."""

import math
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

import duckdb
import pytest

from gridwright.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return x.isoformat() if isinstance(x, (date, datetime)) else str(x)


@pytest.fixture(scope="module")
def answers(spark, request):
    """Columns and rows of the chosen queries, a few of which run at a time: most are short and leave cores idle."""

    def run(name):
        df = catalogue.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        return columns, sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())

    names = [i.callspec.params["name"] for i in request.session.items if i.name.startswith("test_query_equals_sql")]
    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(run, n) for n in names}


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(answers, duck, name):
    columns, ours = answers[name].result()
    found = duck.execute(catalogue.SQL[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    assert ours == sorted(tuple(cell(r[i]) for i in order) for r in found.fetchall())


def test_signbit_query_takes_money_of_minus_zero_for_zero(spark, tmp_path):
    from gridwright.plans import catalogue

    rows = [(1, -0.0, 3), (2, 0.0, 3), (3, -0.01, 3), (4, 0.01, 3)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    assert {r.c_custkey: r.v for r in catalogue.QUERIES["ew_signbit"](spark, str(tmp_path)).collect()} == {1: False, 2: False, 3: True, 4: False}


def test_regions_are_not_broadcast(spark):
    """Tables that generators made look short to Spark."""
    from gridwright.operators import spatial

    image = spark.range(9).selectExpr("0L AS n", "id DIV 3 AS i", "id % 3 AS j", "explode(sequence(0L, 3L)) AS c", "1.0D AS v")
    rois = spark.createDataFrame([(0, 0, 0.0, 0.0, 2.0, 2.0)], "roi long, n long, x1 double, y1 double, x2 double, y2 double")
    plan = spatial.ps_roi_pool(image, rois, 3, 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan

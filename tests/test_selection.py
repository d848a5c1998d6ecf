import math
import random

from pyspark.sql import functions as F

from gridwright.operators import ordered, selection
from gridwright.operators import relational as r


def test_large_groups_are_selected_by_digits(spark, monkeypatch):
    monkeypatch.setattr(selection, "LARGE", 50)
    rng = random.Random(1)
    nan, inf = float("nan"), float("inf")
    value = lambda: rng.choice([None, nan, inf, -inf, 0.0, -0.0, 5e-324, 1.5, 1.5, rng.gauss(0, 1), rng.gauss(0, 1e300)])
    rows = [(rng.choice(["a", "a", "b", None]), value(), i) for i in range(900)] + [("c", value(), 1000 + i) for i in range(20)] + [("d", 2.5, 2000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double, i long").repartition(4)
    order = lambda x: (x[1] is not None, math.isnan(x[1] or 0.0), (x[1] or 0.0) if not math.isnan(x[1] or 0.0) else 0.0, x[2])
    groups = {}
    for x in sorted(rows, key=order):
        groups.setdefault(x[0], []).append(x)
    want = lambda n, m: F.lit(77)
    got = {x.k: x.i for x in selection.select(df, ["k"], "v", "i", want, 50).collect()}
    assert got == {k: g[76][2] for k, g in groups.items() if len(g) >= 77}
    texts = df.withColumn("v", F.col("v").cast("string"))
    assert selection.select(texts, ["k"], "v", "i", want, 50).count() == len(got)
    got = {x.k: x.i for x in selection.select(df, ["k"], "v", "i", lambda n, m: F.when(m > 0, n - m + 1).otherwise(F.floor((n + 1) / 2)), 50).collect()}
    for k, g in groups.items():
        nans = sum(x[1] is not None and math.isnan(x[1]) for x in g)
        assert got[k] == g[len(g) - nans if nans else (len(g) + 1) // 2 - 1][2]


def test_numbers_order_as_values_do(spark):
    xs = [None, float("-inf"), -1e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = [x[0] for x in df.select(selection.order_number(df, "v")).collect()]
    assert got == sorted(got) and len(set(got)) == len(xs)


def test_many_best_rows(spark, monkeypatch):
    monkeypatch.setattr(r, "FEW", 3)
    monkeypatch.setattr(ordered, "PART_ROWS", 60)
    df = spark.createDataFrame([(i % 2, float(i * 7919 % 101), i) for i in range(400)], "k int, v double, i int")
    for largest in (True, False):
        got = {(x.k, x.rank): x.i for x in r.topk(df, ["k"], "v", "i", 40, largest).collect()}
        for k in (0, 1):
            best = sorted((((-x.v if largest else x.v), x.i) for x in df.where(f"k = {k}").collect()))[:40]
            assert [got[k, n + 1] for n in range(40)] == [b[1] for b in best]

import random
from bisect import bisect_right

from pyspark.sql import functions as F

from gridwright.operators import ordered


def hot_rows(n=4000):
    rng = random.Random(2)
    return [(rng.choice([None, "a", "a", "a", "b", "c"]), rng.choice([None, 1, 1, 1, rng.randrange(50)]), i, rng.randrange(-9, 9)) for i in range(n)]


def test_scans_cross_parts(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, t int, i int, v long").repartition(5)
    got = ordered.scan(df, ["k"], ["t", "i"], 100, s=("sum", F.col("v")), m=("max", F.struct("v", "i")), low=("min", F.col("v")))
    want, held = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1] if r[1] is not None else -1, r[2])):
        held.setdefault(k, []).append((v, i))
        want[i] = (sum(x[0] for x in held[k]), max(held[k]), min(held[k])[0])
    assert {r.i: (r.s, tuple(r.m), r.low) for r in got.collect()} == want
    dealt, _ = ordered.dealt(df, ["k", "t"], 100)
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 400  # one key has half of the rows, one time of it most
    numbers = sorted(r.n for r in ordered.numbered(df, ["t"], part_rows=100).collect())
    assert numbers == list(range(len(rows)))
    assert ordered.scan(df.limit(0), ["k"], ["t"], 100, s=("sum", F.col("v"))).count() == 0


def test_asof_join_equals_a_search(spark):
    rng = random.Random(3)
    told = [(rng.choice("ab"), rng.choice([None, *range(0, 900, 3)]), j) for j in range(700)]
    asked = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(1000)]), i) for i in range(1500)]
    left, right = spark.createDataFrame(asked, "k string, t long, i int"), spark.createDataFrame(told, "k string, u long, j int")
    for forward in (False, True):
        got = {r.i: (r.u, r.j) for r in ordered.asof_join(left, right, ["k"], "t", "u", ["u", "j"], forward, 150).collect()}
        assert len(got) == 1500
        for k, t, i in asked:
            fit = [(u, j) for kk, u, j in told if kk == k and u is not None and t is not None and (u >= t if forward else u <= t)]
            near = (min if forward else max)((u for u, _ in fit), default=None)
            assert got[i] == (near, max(j for u, j in fit if u == near)) if fit else got[i] == (None, None)
    series = sorted(u for k, u, _ in told if k == "a" and u is not None)
    assert bisect_right(series, 500) > 0


def test_interval_join_finds_each_pair_once(spark):
    rng = random.Random(4)
    span = lambda: (s := rng.randrange(-2000, 2000), s + rng.choice([0, 1, 5, 40, 700, -3]))
    a = [(i, *span(), i % 3) for i in range(250)] + [(999, None, 5, 0), (998, -5000, 5000, 1)]
    b = [(i, *span(), i % 3) for i in range(250)]
    left, right = spark.createDataFrame(a, "i int, s long, e long, k int"), spark.createDataFrame(b, "j int, u long, v long, k int")
    pairs = [(r.left.i, r.right.j) for r in ordered.interval_join(left, right, ["k"], ("s", "e"), ("u", "v")).collect()]
    want = [(x[0], y[0]) for x in a for y in b if x[3] == y[3] and x[1] is not None and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]]
    assert sorted(pairs) == sorted(want)
    plan = ordered.interval_join(left, right, ["k"], ("s", "e"), ("u", "v"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parts_are_found_by_halving(spark):
    """For any number of cuts, those not above a place are counted."""
    places = spark.range(-1, 45).select(F.struct(F.col("id").alias("c0")).alias("at"))
    for n in (1, 2, 3, 7, 8, 20):
        cuts = [2 * k for k in range(n)]
        got = places.select("at.c0", ordered._part([F.struct(F.lit(c).cast("long").alias("c0")) for c in cuts], F.col("at")).alias("p")).collect()
        assert all(r.p == bisect_right(cuts, r.c0) for r in got)


def test_intervals_have_a_level_for_two_powers_of_two(spark):
    rows = spark.range(300).selectExpr("1 AS k", "id AS i", "id * 3 AS s", "id * 3 + (id * id) % 257 AS e")
    made = ordered.interval_join(rows, rows, ["k"], ("s", "e"), ("s", "e"))
    spans = [(n * 3, n * 3 + n * n % 257) for n in range(300)]
    assert sorted((r.left.i, r.right.i) for r in made.collect()) == [(a, b) for a, x in enumerate(spans) for b, y in enumerate(spans) if x[0] <= y[1] and y[0] <= x[1]]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "[2,4,6,8,10]" in plan.replace(" ", "")

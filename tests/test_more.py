import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridwright.functions import elementwise as e
from gridwright.operators import indexing, linalg, nested, norms, random, relational, spatial, views
from gridwright.operators import more as m


def test_views(spark):
    row = spark.createDataFrame(list(enumerate("abcd")), "i long, v string")
    text = lambda df: "".join(r.v for r in df.orderBy("i").collect())
    assert text(m.flip(row, "i", 4)) == "dcba" and text(m.narrow(row, "i", 1, 2)) == "bc"
    assert [text(x) for x in views.split(row, "i", [1, 3])] == ["a", "bcd"] and [text(x) for x in views.chunk(row, "i", 4, 3)] == ["ab", "cd"]
    axes = lambda how: {"i": spatial.padded(spark, 4, 2, 1, how)}
    numbers = spark.range(4).selectExpr("id AS i", "double(id) AS v", "0 AS n")
    for how, want in (("reflect", [2, 1, 0, 1, 2, 3, 2]), ("replicate", [0, 0, 0, 1, 2, 3, 3])):
        assert [r.v for r in spatial.resample(numbers, axes(how), ["n"]).orderBy("i").collect()] == want


def test_segments(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "i long, v double")
    lengths = spark.createDataFrame([(0, 2), (1, 0), (2, 3)], "segment int, n long")
    for how, want in (("mean", [0.5, math.nan, 3.0]), ("sum", [1.0, 0.0, 9.0]), ("max", [1.0, -math.inf, 4.0]), ("prod", [0.0, 1.0, 24.0])):
        out = {r.segment: r.v for r in indexing.segment_reduce(df, lengths, "i", "v", how).collect()}
        assert all(math.isnan(w) and math.isnan(out[k]) or out[k] == w for k, w in enumerate(want)), how


def test_small_matrices_equal_numpy(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    mats = [rng.standard_normal((4, 4)) for _ in range(5)] + [np.eye(4)[[2, 0, 3, 1]], np.ones((4, 4)), np.diag([0.0, 1, 2, 3])]
    b = rng.standard_normal(4)
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, a in enumerate(mats)], "k int, a array<array<double>>, b array<double>").withColumn("f", linalg.lu(F.col("a")))
    rows = df.select("k", "f", linalg.det(F.col("f")).alias("d"), linalg.slogdet(F.col("f")).alias("s"), linalg.lu_solve(F.col("f"), F.col("b")).alias("x"), linalg.inverse(F.col("f")).alias("i")).collect()
    for r in rows:
        a = mats[r.k]
        lower, upper = np.tril(r.f.lu, -1) + np.eye(4), np.triu(r.f.lu)
        assert np.allclose(lower @ upper, a[list(r.f.perm)]) and np.isclose(r.d, np.linalg.det(a))
        if abs(np.linalg.det(a)) > 1e-9:
            assert np.allclose(r.x, np.linalg.solve(a, b)) and np.allclose(r.i, np.linalg.inv(a)) and np.isclose(r.s.logabsdet, np.linalg.slogdet(a)[1])
        else:
            assert None in r.x and r.s.logabsdet == -math.inf


def test_attention_and_steps(spark):
    rng = np.random.default_rng(0)
    q, k, v = rng.standard_normal((2, 3)), rng.standard_normal((4, 3)), rng.standard_normal((4, 2))
    qs = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(q)], "head int, i int, q array<double>")
    kv = spark.createDataFrame([(0, j, a.tolist(), b.tolist()) for j, (a, b) in enumerate(zip(k, v, strict=True))], "head int, j int, k array<double>, v array<double>")
    e = np.exp(q @ k.T * 0.5)
    want = e / e.sum(1, keepdims=True) @ v
    assert np.allclose([r.out for r in m.attention(qs, kv, 0.5).orderBy("i").collect()], want)
    one = spark.createDataFrame([(1.0, 0.5, 0.0, 0.0, 0.0)], "p double, g double, m double, s double, buf double")
    assert math.isclose(m.adam(one, 1, 0.1).first().p, 0.9, rel_tol=1e-6) and m.sgd(one, 0.1, 0.9).first().p == 0.95


def test_suppression_equals_the_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(3)), i, *(c := rng.integers(0, 12, 2).astype(float)).tolist(), *(c + rng.integers(2, 7, 2)).tolist(), float(rng.integers(8))) for i in range(150)]
    got = {(r.g, r.id) for r in spatial.nms(spark.createDataFrame(rows, "g int, id long, x1 double, y1 double, x2 double, y2 double, score double"), ["g"], 0.4).collect()}
    want = set()
    for g in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[6], r[1])):
            over = lambda s: max(0, min(r[4], s[4]) - max(r[2], s[2])) * max(0, min(r[5], s[5]) - max(r[3], s[3]))  # noqa: B023, E731
            size = lambda s: (s[4] - s[2]) * (s[5] - s[3])
            if all(over(s) <= 0.4 * (size(r) + size(s) - over(s)) for s in kept):
                kept.append(r)
        want |= {(g, r[1]) for r in kept}
    assert got == want


def test_gamma_slope(spark):
    from pyspark.sql import functions as F

    # Gamma(1): x = -log(1 - p), and the slope in the shape by differences of quantiles
    x = 1.3
    row = spark.range(1).select(random.standard_gamma_grad(F.lit(1.0), F.lit(x)).alias("g"), random.special.igamma(F.lit(1.01), F.lit(x + 0.01 * 0.9)).alias("up"), random.special.igamma(F.lit(1.0), F.lit(x)).alias("p")).first()
    assert 0 < row.g < 2 and abs(row.up - row.p) < 0.01


def test_counts_of_draws_fit_their_distributions(spark):
    n = 20_000
    for make, pmf in (
        (lambda: random.poisson(F.lit(12.0), 1), lambda k: math.exp(k * math.log(12) - 12 - math.lgamma(k + 1))),
        (lambda: random.poisson(F.lit(3.0), 2), lambda k: math.exp(k * math.log(3) - 3 - math.lgamma(k + 1))),
        (lambda: random.binomial(60, F.lit(0.7), 3), lambda k: math.comb(60, k) * 0.7**k * 0.3 ** (60 - k) if k <= 60 else 0.0),
        (lambda: random.binomial(30, F.lit(0.1), 4), lambda k: math.comb(30, k) * 0.1**k * 0.9 ** (30 - k) if k <= 30 else 0.0),
    ):
        seen = {int(r.v): r["count"] for r in spark.range(n).select(make().alias("v")).groupBy("v").count().collect()}
        cells = [k for k in range(80) if n * pmf(k) > 8]
        chi = sum((seen.get(k, 0) - n * pmf(k)) ** 2 / (n * pmf(k)) for k in cells)
        assert sum(seen.values()) == n and chi < len(cells) + 5 * math.sqrt(2 * len(cells))
    edge = spark.range(5).select(random.poisson(F.lit(0.0)).alias("a"), random.binomial(9, F.lit(0.0)).alias("b"), random.binomial(9, F.lit(1.0)).alias("c")).distinct().collect()
    assert [tuple(r) for r in edge] == [(0.0, 0.0, 9.0)]


def test_large_rates_keep_their_moments(spark):
    for rate in (0.5, 40.0, 800.0, 2000.0, 1e6):
        m, v = spark.range(20_000).select(random.poisson(F.lit(rate), 7).alias("v")).agg(F.avg("v"), F.var_samp("v")).first()
        assert abs(m - rate) < 5 * math.sqrt(rate / 20_000) and abs(v / rate - 1) < 0.08


def test_ldexp_of_far_exponents(spark):
    rows = [(1e-300, 1100), (1e300, -1100), (1.5, 3), (0.0, 5000), (1.0, 1024), (1.0, -1080), (float("inf"), -3000)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double, n int").select(e.ldexp(F.col("x"), F.col("n"))).collect()]
    assert got == [math.ldexp(1e-300, 1100), math.ldexp(1e300, -1100), 12.0, 0.0, float("inf"), 0.0, float("inf")]


def test_null_groups_masks_and_zeros(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None, 1, 2.0), ("a", 2, 0.0), ("a", 3, 0.0), ("b", 4, nan)], "k string, i long, v double")
    assert {(r.i, None if math.isnan(r.softmax) else round(r.softmax, 6)) for r in relational.softmax(df, ["k"], "v").collect()} == {(1, 1.0), (2, 0.5), (3, 0.5), (4, None)}
    assert relational.layer_norm(df, ["k"], "v").count() == 4
    masked = spark.createDataFrame([(1, None, 1.0), (2, True, 2.0), (3, False, 3.0), (4, True, 4.0)], "i int, m boolean, v double")
    source = spark.createDataFrame([(1, 10.0), (2, None), (3, 30.0)], "j int, s double")
    got = {r.i: r.v for r in indexing.masked_scatter(masked, "i", "m", "v", source, "j", "s").collect()}
    assert got == {1: 1.0, 2: 10.0, 3: 3.0, 4: None}
    short = {r.i: r.v for r in indexing.masked_scatter(masked, "i", "m", "v", source.where("j = 1"), "j", "s").collect()}
    assert short == {1: 1.0, 2: 10.0, 3: 3.0, 4: 4.0}
    found = relational.searchsorted(spark.createDataFrame([(1,), (None,), (5,)], "v int"), spark.createDataFrame([(3,), (None,), (9,)], "v int"), "v")
    assert {(r.v, r.place) for r in found.collect()} == {(3, 1), (None, None), (9, 2)}
    assert {(r.k, r.inverse) for r in relational.unique_inverse(df.select("k"), "k").collect()} == {(None, 0), ("a", 1), ("b", 2)}

    xs, gs = [2.0, 3.0, 0.0, 4.0, 0.0, 5.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    want = [sum(gs[j] * math.prod(x for k, x in enumerate(xs[: j + 1]) if k != i) for j in range(i, 6)) for i in range(6)]
    rows = spark.createDataFrame([(1, i, x, g) for i, (x, g) in enumerate(zip(xs, gs, strict=True))], "k int, i long, x double, g double")
    assert [r.d for r in indexing.cumprod_backward(rows, ["k"], "i", "x", "g").orderBy("i").collect()] == pytest.approx(want)
    for values in ([2.0, 0.0, 3.0], [0.0, 0.0, 3.0], [2.0, 4.0, 3.0]):
        seg = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "segment int, at long, v double")
        d = [r.d for r in indexing.segment_reduce_backward(seg, spark.createDataFrame([(1, 2.0)], "segment int, g double"), "v", "prod").orderBy("at").collect()]
        assert d == pytest.approx([2 * math.prod(v for j, v in enumerate(values) if j != i) for i in range(3)])


def test_gathered_statistics_of_large_means(spark):
    parts = spark.createDataFrame([(0, 1e9, 1 / math.sqrt(1 + 1e-5), 10), (0, 1e9 + 1, 1 / math.sqrt(1 + 1e-5), 10)], "c int, mean double, invstd double, n int")
    r = norms.gather_stats(parts, "c").first()
    assert abs(r.mean - (1e9 + 0.5)) < 1e-6 and abs(r.invstd - 1 / math.sqrt(1.25 + 1e-5)) < 1e-6
    q = spark.createDataFrame([(0.25,), (0.75,), (1.25,), (-9.0,)], "x double").select(nested.quantize_float_qparams(F.col("x"), F.lit(0.5), F.lit(0.5)).alias("q"))
    assert [r.q for r in q.collect()] == [1, 2, 3, 0]


def test_attention_in_blocks_and_its_gradients(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 5)
    rng = np.random.default_rng(8)
    n, d, scale = 23, 3, 0.7
    q, k, v, g = (rng.standard_normal((n, d)) for _ in range(4))
    rows = lambda x, at, name: spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)], f"head int, {at} long, {name} array<double>")
    kv = rows(k, "j", "k").join(rows(v, "j", "v"), ["head", "j"])
    s = q @ k.T * scale
    for causal in (False, True):
        e_ = np.exp(np.where(np.tril(np.ones((n, n))) > 0, s, -np.inf) if causal else s)
        out = m.attention(rows(q, "i", "q"), kv, scale, causal).orderBy("i").collect()
        assert np.allclose([r.out for r in out], e_ / e_.sum(1, keepdims=True) @ v)
    p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    ds = p * (g @ v.T - (p * (g @ v.T)).sum(1, keepdims=True)) * scale
    for got, at, want in zip(m.attention_backward(rows(q, "i", "q"), kv, rows(g, "i", "g"), scale), "ijj", (ds @ k, ds.T @ q, p.T @ g), strict=True):
        found = np.zeros((n, d))
        for r in got.collect():
            found[r[at], r.c] = r.v
        assert np.allclose(found, want)


def test_products_with_a_dense_inner_index(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(-3, 4, (40, 6)), rng.integers(-3, 4, (6, 30))
    a[:, 1:] *= rng.random((40, 5)) < 0.1
    coo = lambda x: spark.createDataFrame([(int(i), int(j), int(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "i long, j long, v long")
    got = np.zeros((40, 30), int)
    for r in linalg.skewed_bmm(coo(a), coo(b), heavy=100, side=7).collect():
        got[r.i, r.j] = r.v
    assert (got == a @ b).all()


def test_products_of_a_dense_inner_index_are_not_shuffled(spark):
    a = spark.createDataFrame([(0, i, 0, (3037000499 if i == 4 else i) if i < 8 else None) for i in range(40)] + [(1, 0, 1, 2), (1, None, 1, 3)], "n int, i long, j long, v long")
    b = linalg.transposed(a)
    made = linalg.skewed_bmm(a, b, ["n"], heavy=100, side=8)
    want = {(r.n, r.i, r.j): r.v for r in linalg.bmm(a, b, ["n"]).collect()}
    rows = made.collect()
    assert {(r.n, r.i, r.j): r.v for r in rows} == want and len(rows) == len(want)
    plan = linalg.skewed_bmm(a.where("n = 0").drop("n"), b.where("n = 0").drop("n"), heavy=100, side=8)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_entries_of_a_dense_product_are_shuffled_once(spark, monkeypatch):
    """Whatever the number of blocks of the other side; a line longer than a block's row may be is copied to each, as before."""
    monkeypatch.setattr(linalg, "ENTRIES", 20)
    monkeypatch.setattr(linalg, "PACK", 2)
    a = spark.createDataFrame([(i, k, None if i == 7 else i + k) for i in range(40) for k in (0, i % 5 + 1, 6)] + [(None, 0, 5), (3, None, 4)], "i long, j long, v long")
    want = {(r.i, r.j): r.v for r in linalg.bmm(a, linalg.transposed(a)).collect()}
    for longest, copied in ((100, False), (2, True)):
        monkeypatch.setattr(linalg, "LONGEST", longest)
        made = linalg.skewed_bmm(a, linalg.transposed(a), heavy=100, side=8)
        assert ("explode" in made._jdf.queryExecution().executedPlan().toString()) == copied
        rows = made.collect()
        assert {(r.i, r.j): r.v for r in rows} == want and len(rows) == len(want)


def test_gradients_of_long_products_are_made_in_blocks(spark, monkeypatch):
    """Every row has each of the weight's columns, so each is an inner index of all rows."""
    monkeypatch.setattr(linalg.skewed_bmm, "__defaults__", (None, 100, linalg.SIDE))
    coo = lambda n, m: spark.range(n * m).selectExpr(f"id DIV {m} AS i", f"id % {m} AS j", "CAST(id % 7 AS DOUBLE) AS v")
    for made in (linalg.matmul_backward(coo(60, 3), coo(60, 4), coo(4, 3))[0], linalg.linear_backward(coo(60, 3), coo(60, 4), coo(3, 4))[0]):
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == 240


def test_products_are_made_in_strips(monkeypatch):
    monkeypatch.setattr(linalg, "STRIP", 50)
    monkeypatch.setattr(linalg, "BATCH", 7)
    rng = np.random.default_rng(4)
    a, b = rng.integers(-5, 6, (30, 12)), rng.integers(-5, 6, (12, 20))
    lists = lambda m: [pa.chunked_array([c]) for c in (pa.array(range(len(m))), pa.array([list(range(12))] * len(m)), pa.array(m.tolist(), pa.list_(pa.int64())))]
    got = np.zeros((30, 20), int)
    for i, j, v in linalg._cells([*lists(a), *lists(b.T)], True):
        assert len(i) <= 7
        got[i.to_numpy(), j.to_numpy()] += v.to_numpy()
    assert (got == a @ b).all()


def test_windows_of_any_size_and_step(spark):
    rows = [(None, i, i * 10) for i in range(11)] + [(1, i, None if i else 5) for i in range(2)]
    df = spark.createDataFrame(rows, "k int, i long, v long")
    for size, step in ((3, 1), (2, 3), (4, 2), (5, 5)):
        got = sorted((r.k or 0, r.i, r.window_no, str(r.window)) for r in relational.unfold(df, ["k"], "i", "v", size, step).collect())
        runs = {0: [r[2] for r in rows if r[0] is None], 1: [r[2] for r in rows if r[0] == 1]}
        assert got == sorted((k, s, s // step, str(x[s : s + size])) for k, x in runs.items() for s in range(0, len(x) - size + 1, step))

import numpy as np
from pyspark.sql import functions as F

from gridwright.operators import fourier, tall


def table(spark, a, parts=5):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "i int, x array<double>").repartition(parts, "i")


def test_tall_factors(spark, monkeypatch):
    monkeypatch.setattr(tall, "CHUNK", 40)
    monkeypatch.setattr(tall, "MIDDLE", 3)
    rng = np.random.default_rng(1)
    a = rng.standard_normal((300, 7)) @ np.diag(10.0 ** np.arange(0, -14, -2))  # condition 1e12
    df, r = tall.tall_qr(table(spark, a), "x")
    q = np.array([x.q for x in df.orderBy("i").collect()])
    assert np.allclose(q.T @ q, np.eye(7), atol=1e-12) and np.allclose(q @ r, a, atol=1e-13) and (np.diag(r) >= 0).all() and np.allclose(r, np.triu(r))
    y = rng.standard_normal((300, 2))
    b = rng.standard_normal((300, 4))
    both = table(spark, np.hstack([b, y]))
    got = tall.tall_lstsq(both.withColumn("v", F.slice("x", 1, 4)), "v", [F.col("x")[4], F.col("x")[5]]).orderBy("target").collect()
    assert np.allclose(np.array([g.x for g in got]).T, np.linalg.lstsq(b, y)[0])
    df, s, v = tall.tall_svd(table(spark, b), "x")
    u = np.array([x.u for x in df.orderBy("i").collect()])
    assert np.allclose(s, np.linalg.svd(b)[1]) and np.allclose((u * s) @ v, b) and np.allclose(u.T @ u, np.eye(4))
    flat = np.outer(np.arange(1, 9), [1.0, 2.0])
    df, r = tall.tall_qr(table(spark, flat), "x")
    assert np.allclose(np.array([x.q for x in df.orderBy("i").collect()]) @ r, flat) and abs(r[1, 1]) < 1e-12
    assert tall.tall_r(table(spark, b).limit(0), "x").shape == (0, 0)
    assert np.allclose(tall.triangle(rng.standard_normal((2, 4)))[2:], 0)


def test_block_cholesky(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((11, 20))
    g = a @ a.T
    m = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(11) for j in range(11)], "i long, j long, v double")
    low = np.zeros((11, 11))
    for r in tall.block_cholesky(m, 11, 4).collect():
        low[r.i, r.j] = r.v
    assert np.allclose(low, np.linalg.cholesky(g))


def test_transforms(spark):
    rng = np.random.default_rng(3)
    for shape, dims in (([64], None), ([60], None), ([61], None), ([1], None), ([11], None), ([4, 6], None), ([3, 13, 2], [1]), ([5, 4], [0])):
        x = rng.standard_normal(shape) + 1j * rng.standard_normal(shape)
        df = spark.createDataFrame([([(float(z.real), float(z.imag)) for z in x.ravel()],)], "x array<struct<re:double,im:double>>")
        for inverse, norm in ((False, "backward"), (True, "backward"), (False, "ortho"), (True, "forward")):
            got = fourier.fft(df, "x", "y", shape, dims, inverse, norm).first().y
            axes = dims if dims is not None else list(range(len(shape)))
            want = (np.fft.ifftn if inverse else np.fft.fftn)(x, axes=axes, norm=norm)
            assert np.allclose(np.array([z.re + 1j * z.im for z in got]).reshape(shape), want)
    for n in (8, 9, 61):
        x = rng.standard_normal(n)
        df = fourier.rfft(spark.createDataFrame([(x.tolist(),)], "x array<double>"), "x", "h", n)
        assert np.allclose([z.re + 1j * z.im for z in df.first().h], np.fft.rfft(x))
        assert np.allclose(fourier.irfft(df, "h", "back", n).first().back, x)


def test_transforms_of_a_prime_length_are_made_by_arrays(spark):
    """One step of Python a transform, no array expression for each number; missing numbers stay missing, and numbers past the length aren't read."""
    x = np.random.default_rng(3).normal(size=61)
    df = spark.createDataFrame([(0, x.tolist()), (1, [*x.tolist(), 5.0]), (2, [None, *x.tolist()[1:]]), (3, None)], "n int, x array<double>")
    half = fourier.rfft(df, "x", "h", 61)
    assert "Generate" not in half._jdf.queryExecution().executedPlan().toString()
    got = {r.n: r for r in fourier.irfft(half, "h", "back", 61).collect()}
    for n in (0, 1):
        assert np.allclose([z.re + 1j * z.im for z in got[n].h], np.fft.rfft(x)) and np.allclose(got[n].back, x)
    for n in (2, 3):
        assert [z.re for z in got[n].h] == [None] * 31 and got[n].back == [None] * 61


def test_a_task_of_q_has_one_python_worker(spark, monkeypatch):
    """Rows are solved and folded by the same worker; only the result has a column made of its own."""
    made, each = [], tall._each
    monkeypatch.setattr(tall, "_each", lambda *a: made.append(a) or each(*a))
    a = np.random.default_rng(5).standard_normal((60, 3))
    df, r = tall.tall_qr(table(spark, a), "x")
    q = np.array([row.q for row in df.orderBy("i").collect()])
    plan = df.select(F.explode("q"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert len(made) == 1 and np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(3))

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import factor as f
from gridwright.operators import linalg

rng = np.random.default_rng(7)


def table(spark, matrices, b=None):
    rows = [(i, m.tolist(), (b[i] if b is not None else m[:, 0]).tolist()) for i, m in enumerate(matrices)]
    return spark.createDataFrame(rows, "i int, m array<array<double>>, b array<double>")


def got(df, **columns):
    rows = df.select("i", *[c.alias("o_" + n) for n, c in columns.items()]).orderBy("i").collect()
    return [[np.array(r["o_" + n]) if not hasattr(r["o_" + n], "asDict") else r["o_" + n] for n in columns] for r in rows]


def test_cholesky_and_ldl(spark):
    ms = [(x @ x.T) for x in (rng.standard_normal((n, n + 1)) for n in (1, 2, 3, 5))]
    df = table(spark, ms).withColumn("l", f.cholesky(F.col("m"))).withColumn("ld", f.ldl(F.col("m")))
    for m, (low, info, x, inv, y) in zip(ms, got(df, l=F.col("l"), info=f.cholesky_info(F.col("l")), x=f.cholesky_solve(F.col("l"), F.col("b")), inv=f.cholesky_inverse(F.col("l")), y=f.ldl_solve(F.col("ld"), F.col("b"))), strict=True):
        assert np.allclose(low, np.linalg.cholesky(m)) and info == 0
        unit = np.eye(len(m))[0]
        assert np.allclose(x, unit, atol=1e-8) and np.allclose(y, unit, atol=1e-8) and np.allclose(inv, np.linalg.inv(m))
    bad = table(spark, [np.array([[1.0, 2.0], [2.0, 1.0]]), np.zeros((2, 2)), np.array([[-1.0]])]).withColumn("l", f.cholesky(F.col("m")))
    assert [int(x[0]) for x in got(bad, info=f.cholesky_info(F.col("l")))] == [2, 1, 1]


def test_reflections(spark):
    ms = [rng.standard_normal(s) for s in ((1, 1), (3, 3), (5, 3), (4, 1))] + [np.array([[0.0, 1], [0, 2]]), np.array([[1.0, 2], [0, 3]])]
    df = table(spark, ms).withColumn("q", f.geqrf(F.col("m")))
    for m, (q, r, tau) in zip(ms, got(df, q=f.householder_product(F.col("q")), r=f.r_rows(F.col("q")), tau=F.col("q.tau")), strict=True):
        assert np.allclose(q.T @ r, m) and np.allclose(q @ q.T, np.eye(len(q))) and np.allclose(r, np.triu(r)) and len(tau) == min(m.shape)
    tall = [rng.standard_normal((6, 3)) for _ in range(4)]
    b = [rng.standard_normal(6) for _ in range(4)]
    df = table(spark, tall, b).withColumn("q", f.geqrf(F.col("m")))
    for m, y, (x, z) in zip(tall, b, got(df, x=f.lstsq(F.col("q"), F.col("b")), z=f.ormqr(F.col("q"), f.ormqr(F.col("q"), F.array("b"), True))), strict=True):
        assert np.allclose(x, np.linalg.lstsq(m, y)[0]) and np.allclose(z[0], y)


def test_symmetric_eigenvalues_and_singular_values(spark):
    ms = [x + x.T for x in (rng.standard_normal((n, n)) for n in (1, 2, 4, 6))] + [np.eye(3), np.zeros((2, 2)), np.diag([2.0, -1, 2])]
    for m, (v,) in zip(ms, got(table(spark, ms), v=f.eigh(F.col("m"))), strict=True):
        vec = np.array(v.vectors)
        assert np.allclose(v["values"], np.linalg.eigvalsh(m)) and np.allclose(vec @ vec.T, np.eye(len(m))) and np.allclose(vec @ m, np.array(v["values"])[:, None] * vec)
    ms = [rng.standard_normal(s) for s in ((3, 3), (5, 2), (4, 4))] + [np.ones((3, 2)), np.zeros((2, 2))]
    for m, (v,) in zip(ms, got(table(spark, ms), v=f.svd(F.col("m"))), strict=True):
        u, s, w = np.array(v.u), np.array(v["values"]), np.array(v.v)
        assert np.allclose(s, np.linalg.svd(m)[1], atol=1e-9) and np.allclose((u.T * s) @ w, m)


def test_exponentials_and_general_eigenvalues(spark):
    ms = [np.array([[0.0, 1, 2], [0, 0, 3], [0, 0, 0]]), np.array([[0.0, -2], [2, 0]]), np.array([[0.0, -40], [40, 0]]), np.zeros((2, 2)), np.array([[3.0]])]
    want = [np.array([[1, 1, 3.5], [0, 1, 3], [0, 0, 1]])] + [np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]) for t in (2, 40)] + [np.eye(2), np.array([[np.e**3]])]
    for w, (x,) in zip(want, got(f.matrix_exp(table(spark, ms), "m", "e"), x=F.col("e")), strict=True):
        assert np.allclose(x, w, rtol=1e-9, atol=1e-9)
    ms = [rng.standard_normal((n, n)) for n in (1, 2, 3, 4, 5)] + [np.array([[0.0, -2], [2, 0]])]
    for m, (pairs,) in zip(ms, got(table(spark, ms), e=F.transform(f.eig(F.col("m")), lambda p: F.to_json(p))), strict=True):
        import json

        found = [json.loads(p) for p in pairs]
        z = np.array([p["value"]["re"] + 1j * p["value"]["im"] for p in found])
        assert np.allclose(np.sort_complex(np.round(z, 6)), np.sort_complex(np.round(np.linalg.eigvals(m), 6)))
        for lam, p in zip(z, found, strict=True):
            v = np.array([c["re"] + 1j * c["im"] for c in p["vector"]])
            assert np.allclose(m @ v, lam * v, atol=1e-6) and np.isclose(np.linalg.norm(v), 1)
    triple = got(table(spark, [np.array([[0.0, 1, 2], [0, 0, 3], [0, 0, 0]])]), e=F.transform(f.eigvals(F.col("m")), lambda z: F.hypot(z["re"], z["im"])))
    assert np.abs(triple[0][0]).max() < 1e-3


def test_lu_unpack(spark):
    ms = [rng.standard_normal((n, n)) for n in (1, 3, 4)]
    df = table(spark, ms).withColumn("f", linalg.lu(F.col("m"))).withColumn("u", f.lu_unpack(F.col("f")))
    for m, (p, low, up) in zip(ms, got(df, p=F.col("u.p"), l=F.col("u.l"), u=F.col("u.u")), strict=True):
        assert np.allclose(p @ low @ up, m) and np.abs(low).max() <= 1 and np.allclose(up, np.triu(up))


@pytest.mark.parametrize("n", [0, 3])
def test_counting(spark, n):
    assert list(spark.range(1).select(f.upto(F.lit(n))).first()[0]) == list(range(n))


def test_matrices_of_rows_have_no_factors_that_nobody_reads(spark):
    from gridwright.plans import factor_queries

    plan = factor_queries.rows_of(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "perm" not in plan

import math

import numpy as np

from gridwright.operators import grid, linalg, more


def test_distances_in_blocks_and_their_gradients(spark, monkeypatch):
    """Blocks of 5 rows; one pair of rows is equal and one vector is missing."""
    monkeypatch.setattr(grid, "ROWS", 5)
    monkeypatch.setattr(grid, "STRIP", 8)
    x = np.random.default_rng(4).normal(size=(17, 3))
    x[9] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(17, None)], "n long, a array<double>")
    queries = df.where("n % 3 = 0").withColumnsRenamed({"n": "q", "a": "b"})
    asked = [i for i in range(17) if i % 3 == 0]
    gap = x[:, None] - x[None]
    for p in (1.0, 2.0, 3.0, math.inf):
        d = np.linalg.norm(gap, ord=p, axis=2)
        slope = np.where((d > 0)[:, :, None], np.sign(gap) * ((np.abs(gap) == d[:, :, None]) if math.isinf(p) else (np.abs(gap) / np.where(d == 0, 1, d)[:, :, None]) ** (p - 1)), 0)
        got = {(r.n, r.q): r.d for r in linalg.cdist(df, queries, "n", "a", "q", "b", p).collect()}
        assert len(got) == 18 * 6 and got[17, 0] is None
        assert np.allclose([[got[i, j] for j in asked] for i in range(17)], d[:, asked])
        pairs = {(r.a, r.b): r.d for r in linalg.pdist(df, "n", "a", p).collect()}
        assert set(pairs) == {(i, j) for j in range(18) for i in range(j)} and pairs[3, 17] is None
        assert np.allclose([pairs[i, j] for j in range(17) for i in range(j)], [d[i, j] for j in range(17) for i in range(j)])
        for rows, want in ((linalg.cdist_backward(df, queries, "n", "a", "q", "b", p), slope[:, asked].sum(1)), (linalg.pdist_backward(df, "n", "a", p), slope.sum(1))):
            seen = {(r.n, r.c): r.v for r in rows.collect()}
            assert np.allclose([[seen[i, c] for c in range(3)] for i in range(17)], want)


def test_a_key_that_is_null_takes_no_part_in_attention(spark, monkeypatch):
    monkeypatch.setattr(more, "BLOCK", 5)
    x = np.random.default_rng(5).normal(size=(12, 3, 2))
    q = spark.createDataFrame([(0, i, v[0].tolist()) for i, v in enumerate(x)], "head long, i long, q array<double>")
    kv = spark.createDataFrame([(0, i, v[1].tolist() if i else None, v[2].tolist()) for i, v in enumerate(x)], "head long, j long, k array<double>, v array<double>")
    p = np.exp(x[:, 0] @ x[1:, 1].T)
    want = p / p.sum(1, keepdims=True) @ x[1:, 2]
    assert np.allclose([r.out for r in more.attention(q, kv, 1.0).orderBy("i").collect()], want)


def test_blocks_of_distances_are_not_copied_for_each_other(spark, monkeypatch):
    """Each side is shuffled once, whatever the number of blocks of the other; a pair's task reads them."""
    monkeypatch.setattr(grid, "ROWS", 5)
    df = spark.range(17).selectExpr("id AS n", "array(CAST(id AS DOUBLE), 1D) AS a")
    asked = df.where("n % 3 = 0").withColumnsRenamed({"n": "q", "a": "b"})
    for made, size in ((linalg.cdist(df, asked, "n", "a", "q", "b"), 17 * 6), (linalg.pdist(df, "n", "a"), 17 * 8)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan
        assert made.count() == size

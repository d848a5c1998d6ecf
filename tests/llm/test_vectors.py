import hashlib
import math
import random
from fractions import Fraction

import numpy as np

from gridwright.llm import vectors as V


def plain(rows):
    """Codes by the definition, in exact integers: {(vec_id, vector): (code, error)}, digest of the codebooks."""
    kept = [(i, tuple(math.floor(Fraction(x) * 4096) for x in v), tuple(v)) for i, _, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = next((len(r[1]) for r in kept if r[1] and len(r[1]) % 8 == 0), 0)
    kept = [r for r in kept if len(r[1]) == width]
    d = width // 8
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(r[1], p) for r in kept[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(v, e), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        for p in range(8):
            mine = {}
            for r in kept:
                mine.setdefault(best(cut(r[1], p), p)[1], []).append(cut(r[1], p))
            books[p] = [tuple(sum(c) // len(mine[k]) for c in zip(*mine[k], strict=True)) if k in mine else e for k, e in enumerate(books[p])]
    out = {}
    for r in kept:
        found = [best(cut(r[1], p), p) for p in range(8)]
        error = sum(f[0] for f in found)
        out[r[0], r[2]] = ("".join(f"{f[1]:02x}" for f in found), error if error < 1 << 63 else None)
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label string, embedding array<double>, code string, _null int")
    out, books = V.compress(df.repartition(3))
    want, sha = plain(rows)
    got = out.collect()
    by_id = {}
    for (i, _), x in want.items():
        by_id.setdefault(i, []).append(x)
    assert books.sha256() == sha
    for r in got:
        assert (r.code, r.error) in by_id.get(r.vec_id, []) or r.code is None
    return got, want


def test_codes_equal_exact_ones(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 5)
    rng = random.Random(5)
    rows = [(i, "ab"[i % 2], [rng.choice([-1.0, -0.3, 0.0, 0.25, 0.5, rng.gauss(0, 1)]) for _ in range(16)]) for i in range(300)]
    rows += [(1000 + i, None, rows[7][2]) for i in range(200)]
    got, want = check(spark, rows)
    assert len(got) == 500 and {r.vec_id: (r.code, r.error) for r in got} == {k[0]: v for k, v in want.items()}


def test_odd_rows(spark):
    good = [0.5 * j for j in range(8)]
    rows = [
        (1, "a", None), (2, "a", [None] * 8), (3, None, [float("nan")] * 8), (4, None, [float("inf")] + [0.0] * 7), (5, "a", good), (5, "a", good), (5, "a", [x + 1 for x in good]),
        (None, "b", [-x for x in good]), (6, "b", [1.0] * 16), (7, "b", []), (8, "b", [1e300, -1e308, 5e-324, -5e-324, 0.0, -0.0, 1e12, 40000.0]), (9, "b", [7.9999, -8.0, 8.0, -8.00001, 40000.0, 1e5, 1.0, 2.0]),
    ]
    got, want = check(spark, rows)
    assert len(got) == 8 and sum(r.code is None for r in got) == 2
    assert {(r.vec_id, r.code, r.error) for r in got if r.code} == {(k[0], *v) for k, v in want.items()}
    assert sum(r.vec_id == 5 for r in got) == 3
    empty, books = V.compress(spark.createDataFrame([], "vec_id long, label string, embedding array<double>"))
    assert empty.count() == 0 and books is None


def test_the_curve_visits_every_place_and_steps_by_one():
    for dims, bits in ((2, 3), (3, 2), (2, 4)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        at = V.hilbert(grid, bits)
        assert sorted(at.tolist()) == list(range(side**dims))
        assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_shortlists_hold_every_nearest_entry_and_leave_some_out():
    rng = np.random.default_rng(6)
    books = V.Books([rng.integers(-50, 50, (16, 4)).tolist() for _ in range(8)])
    short = 0
    for _ in range(200):
        pts = rng.integers(-60, 60, 4) + rng.integers(0, 12, (30, 4))
        chosen = books.shortlist(0, [*pts.min(axis=0), *pts.max(axis=0)])
        a, b = books.nearest(0, chosen, pts), books.nearest(0, np.arange(16), pts)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
        short += len(chosen) < 8
    assert short > 50


def test_label_errors(spark, tmp_path):
    rows = [(i, i % 3 if i % 4 else None, [float((i * j) % 7) for j in range(8)]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = V.op11_vector_codes(spark, str(tmp_path)).collect()
    labels, total = dict((r[0], r[1]) for r in rows), {}
    for r in got:
        total[labels[r.vec_id]] = total.get(labels[r.vec_id], 0) + r.error
    assert len(got) == 60 and all(r.label_error == total[labels[r.vec_id]] for r in got)

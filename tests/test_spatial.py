"""Regions of interest against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import spatial

H, W, OUT = 11, 19, 2


@pytest.fixture(scope="module")
def regions(spark):
    """Two images of 8 channels over several tiles, with null, missing and repeated cells; regions in several tiles, at and beyond the edges."""
    rng = np.random.default_rng(3)
    cells = [(n, c, i, j, float(rng.integers(-9, 9))) for n in range(2) for c in range(8) for i in range(H) for j in range(W)]
    cells = [(*r[:4], None) if k % 97 == 0 else r for k, r in enumerate(cells) if k % 31]
    cells += cells[5:9]
    rois = [(0, 0, 1.3, 2.2, 17.9, 9.4), (1, 1, -3.0, -2.0, 4.0, 30.0), (2, 1, 15.5, 7.5, 19.0, 11.0), (3, 0, 40.0, 40.0, 50.0, 50.0), (4, 7, 0.0, 0.0, 5.0, 5.0), (5, 1, 8.0, 8.0, 8.0, 8.0)]
    order = rng.permutation(len(cells))
    df = spark.createDataFrame([cells[k] for k in order], "n long, c long, i long, j long, v double").repartition(3)
    return cells, rois, df, spark.createDataFrame(rois, "roi long, n long, x1 double, y1 double, x2 double, y2 double")


def held(cells):
    out = {}
    for n, c, i, j, v in cells:
        out.setdefault((n, c, i, j), []).append(v)
    return out


def equal(df, want):
    got = {(r.roi, r.c, r.oi, r.oj): r.v for r in df.collect()}
    assert got.keys() == want.keys()
    assert all((v is None) == (want[k] is None) and (v is None or math.isclose(v, want[k], abs_tol=1e-9)) for k, v in got.items())


def summed(read, how):
    """Null where all that is read is null."""
    return {k: how(known) if (known := [x for x in v if x[1] is not None]) else None for k, v in read.items()}


def test_bins_of_regions_in_several_tiles(spark, regions):
    cells, rois, df, table = regions
    by, read = held(cells), {}
    for roi, n, x1, y1, x2, y2 in rois:
        for c, oi, oj, a, b in np.ndindex(2, OUT, OUT, 3, 3):
            y, x = y1 * 0.9 - 0.5 + (oi + (a + 0.5) / 3) * (y2 - y1) * 0.9 / OUT, x1 * 0.9 - 0.5 + (oj + (b + 0.5) / 3) * (x2 - x1) * 0.9 / OUT
            if -1 <= y <= H and -1 <= x <= W:
                y, x = min(max(y, 0), H - 1), min(max(x, 0), W - 1)
                for i in {math.floor(y), min(math.floor(y) + 1, H - 1)}:
                    for j in {math.floor(x), min(math.floor(x) + 1, W - 1)}:
                        w = (1 - abs(y - i)) * (1 - abs(x - j)) / 9
                        for v in by.get((n, (c * OUT + oi) * OUT + oj, i, j), []):
                            read.setdefault((roi, c, oi, oj), []).append((w, v))
    equal(spatial.ps_roi_align(df, table, H, W, OUT, 3, 0.9), summed(read, lambda x: sum(w * v for w, v in x)))


def test_whole_cells_of_regions_in_several_tiles(spark, regions):
    cells, rois, df, table = regions
    by, read = held(cells), {}
    for roi, n, x1, y1, x2, y2 in rois:
        for c, oi, oj, i, j in np.ndindex(2, OUT, OUT, H, W):
            a, b, z, e = (math.floor(abs(x) + 0.5) * math.copysign(1, x) for x in (y1, x1, y2, x2))
            h, w = max(z - a, 0.1) / OUT, max(e - b, 0.1) / OUT
            if math.floor(oi * h) + a <= i < math.ceil((oi + 1) * h) + a and math.floor(oj * w) + b <= j < math.ceil((oj + 1) * w) + b:
                for v in by.get((n, (c * OUT + oi) * OUT + oj, i, j), []):
                    read.setdefault((roi, c, oi, oj), []).append((1, v))
    equal(spatial.ps_roi_pool(df, table, H, W, OUT), summed(read, lambda x: sum(v for _, v in x) / len(x)))


@pytest.mark.parametrize("name", ["ps_roi_align", "ps_roi_pool"])
def test_images_by_channel_are_shuffled_in_tiles(spark, name):
    """Not a row a cell, and not broadcast at any size."""
    image = spark.range(64).selectExpr("0L AS n", "id DIV 8 AS i", "id % 8 AS j", "explode(sequence(0L, 3L)) AS c", "1.0D AS v").coalesce(1)
    assert spatial._packed(image, 2).count() == 4
    rois = spark.createDataFrame([(0, 0, 0.0, 0.0, 2.0, 2.0)], "roi long, n long, x1 double, y1 double, x2 double, y2 double")
    more = (2,) if name == "ps_roi_align" else ()
    plan = getattr(spatial, name)(image, rois, 8, 8, 2, *more)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_neighbours_meet_before_they_are_mapped(spark, monkeypatch):
    """A row becomes 16 products here: partial sums of scattered cells would be a row for each of them."""
    rng = np.random.default_rng(4)
    image = rng.integers(-9, 9, (9, 9)).astype(float)
    rows = [(0, i, j, float(image[i, j])) for i, j in np.ndindex(9, 9)]
    df = spark.createDataFrame([rows[k] for k in rng.permutation(81)], "n long, i long, j long, v double").repartition(4)
    axes = {c: spatial.cubic(spark, 9, 5) for c in "ij"}
    w = np.zeros((5, 9))
    for r in axes["i"].collect():
        w[r.o, r.i] = r.w
    back = {c: a.select(F.col("o").alias("i"), F.col("i").alias("o"), "w") for c, a in axes.items()}
    for near in (64, 4):
        monkeypatch.setattr(spatial, "NEAR", near)
        for got, want in ((spatial.resample(df, axes, ["n"]), w @ image @ w.T), (spatial.resample_backward(df, back, ["n"]), w @ image @ w.T)):
            assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
            found = np.full(want.shape, np.nan)
            for r in got.collect():
                found[r.i, r.j] = r.v
            assert np.allclose(found, want)

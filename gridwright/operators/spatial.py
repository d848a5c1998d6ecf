"""Pooling, padding and resampling over images in coordinate form, as linear maps held in small axis tables.

An image table has id columns, one column a dimension (from 0) and a value. What an operator does along a dimension is a table of (o, i, w):
output place o takes w of input place i. Its length is the dimension's length times the window's; Spark knows it (it is a range) and broadcasts it
where it is short. An operator of several dimensions joins one axis table for each and sums products of weights (or takes maxima); its gradient is the same join from o to i.
Every forward and backward operator is one shuffle, with partial sums before it; linear maps bring an image's neighbours together before that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import factor

#: Cells along a side of the tiles in which images by channel are shuffled.
TILE = 8
#: And of those whose cells meet before they are mapped along axes.
NEAR = 64


# axis tables
def _taps(spark: SparkSession, out: int, first: Column, last: Column) -> DataFrame:
    return spark.range(out).withColumnRenamed("id", "o").withColumn("i", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def _clip(c: Column, size: int) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(size - 1)).cast("long")


def nearest(spark: SparkSession, size: int, out: int, exact: bool = False) -> DataFrame:
    at = F.floor((F.col("id") + (0.5 if exact else 0.0)) * (size / out))
    return spark.range(out).select(F.col("id").alias("o"), F.least(at, F.lit(size - 1)).cast("long").alias("i"), F.lit(1.0).alias("w"))


def _source(size: int, out: int, corners: bool) -> Column:
    o = F.col("o")
    return o * ((size - 1) / (out - 1) if out > 1 else 0.0) if corners else (o + 0.5) * (size / out) - 0.5


def linear(spark: SparkSession, size: int, out: int, corners: bool = False) -> DataFrame:
    o = spark.range(out).withColumnRenamed("id", "o").withColumn("x", F.greatest(_source(size, out, corners), F.lit(0.0)))
    o = o.withColumn("a", F.least(F.floor("x"), F.lit(size - 1)).cast("long"))
    two = F.array(F.struct(F.col("a").alias("i"), (1 - F.col("x") + F.col("a")).alias("w")), F.struct(F.least(F.col("a") + 1, F.lit(size - 1)).alias("i"), (F.col("x") - F.col("a")).alias("w")))
    return o.select("o", F.inline(two)).groupBy("o", "i").agg(F.sum("w").alias("w"))


def _keys(x: Column, a: float) -> Column:
    """The cubic convolution kernel."""
    x = F.abs(x)
    near, far = ((a + 2) * x - (a + 3)) * x * x + 1, ((x - 5) * x + 8) * x * a - 4 * a
    return F.when(x <= 1, near).when(x < 2, far).otherwise(0.0)


def cubic(spark: SparkSession, size: int, out: int, corners: bool = False) -> DataFrame:
    x = _source(size, out, corners)
    taps = _taps(spark, out, F.floor(x) - 1, F.floor(x) + 2).withColumn("w", _keys(_source(size, out, corners) - F.col("i"), -0.75))
    return taps.groupBy("o", _clip(F.col("i"), size).alias("i")).agg(F.sum("w").alias("w"))


def antialiased(spark: SparkSession, size: int, out: int, how: str) -> DataFrame:
    """how: linear or cubic, with the kernel widened where the output is smaller."""
    scale = size / out
    wide, reach = max(scale, 1.0), (1 if how == "linear" else 2) * max(scale, 1.0)
    centre = (F.col("o") + 0.5) * scale
    first, last = F.greatest(F.floor(centre - reach + 0.5), F.lit(0)), F.least(F.floor(centre + reach + 0.5), F.lit(size)) - 1
    x = (F.col("i") - centre + 0.5) / wide
    taps = _taps(spark, out, first, last).withColumn("w", F.greatest(1 - F.abs(x), F.lit(0.0)) if how == "linear" else _keys(x, -0.5))
    return taps.join(taps.groupBy("o").agg(F.sum("w").alias("_s")), "o").select("o", "i", (F.col("w") / F.col("_s")).alias("w"))


def pooled_size(size: int, window: int, stride: int, pad: int = 0, dilation: int = 1, ceil: bool = False) -> int:
    span = size + 2 * pad - dilation * (window - 1) - 1
    out = (span + (stride - 1 if ceil else 0)) // stride + 1
    return out - 1 if ceil and (out - 1) * stride >= size + pad else out


def windows(spark: SparkSession, size: int, window: int, stride: int, pad: int = 0, dilation: int = 1, ceil: bool = False, include_pad: bool = True) -> DataFrame:
    """Also k, the place in the window. w is the share of the window's length; that of what lies inside, without include_pad."""
    out = pooled_size(size, window, stride, pad, dilation, ceil)
    start = F.col("o") * stride - pad
    taps = spark.range(out).withColumnRenamed("id", "o").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).withColumn("i", start + F.col("k") * dilation)
    end = F.least(start + window, F.lit(size + pad))
    whole = end - start if include_pad else F.least(end, F.lit(size)) - F.greatest(start, F.lit(0))
    return taps.where((F.col("i") >= 0) & (F.col("i") < size)).select("o", "i", (1 / whole).alias("w"), F.col("k").cast("long").alias("k"))


def adaptive(spark: SparkSession, size: int, out: int) -> DataFrame:
    first, end = F.floor(F.col("o") * size / out), F.ceil((F.col("o") + 1) * size / out)
    return _taps(spark, out, first, end - 1).withColumn("w", 1 / (end - first))


def fractional(spark: SparkSession, size: int, out: int, window: int, sample: float) -> DataFrame:
    """Windows whose starts are spread by a number from 0 to 1; the last one ends at the end."""
    step = (size - window) / (out - 1) if out > 1 else 0.0
    first = F.when(F.col("o") == out - 1, F.lit(size - window)).otherwise(F.floor((F.col("o") + sample) * step) - int(sample * step))
    return _taps(spark, out, first, first + window - 1).withColumn("w", F.lit(1.0))


def padded(spark: SparkSession, size: int, before: int, after: int, how: str) -> DataFrame:
    """how: reflect (without the edge itself) or replicate."""
    at = F.col("id") - before
    at = size - 1 - F.abs(size - 1 - F.abs(at)) if how == "reflect" else F.least(F.greatest(at, F.lit(0)), F.lit(size - 1))
    return spark.range(size + before + after).select(F.col("id").alias("o"), at.cast("long").alias("i"), F.lit(1.0).alias("w"))


# operators
def _joined(df: DataFrame, axes: dict[str, DataFrame], side: str, other: str) -> tuple[DataFrame, Column]:
    weight = []
    for n, (c, axis) in enumerate(axes.items()):
        axis = axis.select(F.col(side).alias(c), F.col(other).alias(f"_{c}"), F.col("w").alias(f"_w{n}"))
        df = df.join(axis, c)
        weight.append(F.col(f"_w{n}"))
    return df, reduce(lambda a, b: a * b, weight)


def _mapped(df: DataFrame, axes: dict[str, DataFrame], ids: list[str], value: str, side: str, other: str) -> DataFrame:
    cells, weight = _joined(_near(df, axes, ids), axes, side, other)
    return cells.groupBy(*ids, *[F.col(f"_{c}").alias(c) for c in axes]).agg(F.sum(weight * F.col(value)).alias(value))


def _near(df: DataFrame, axes: dict[str, DataFrame], ids: list[str]) -> DataFrame:
    """df with neighbours of an image in one task, so that partial sums take their products together. As many parts as the session shuffles into, and
    not fewer for being short: a row becomes many products, whose sums a task holds."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *ids, *[F.floor(F.col(c) / NEAR) for c in axes])


def resample(df: DataFrame, axes: dict[str, DataFrame], ids: list[str], value: str = "v") -> DataFrame:
    """Upsampling, average pooling and padding: each output cell is a weighted sum of input cells."""
    return _mapped(df, axes, ids, value, "i", "o")


def resample_backward(grad: DataFrame, axes: dict[str, DataFrame], ids: list[str], value: str = "v") -> DataFrame:
    """What each input cell gets from the gradients of the output cells that it went into. Cells that went into none have no row."""
    return _mapped(grad, axes, ids, value, "o", "i")


def max_pool(df: DataFrame, axes: dict[str, DataFrame], sizes: dict[str, int], ids: list[str], value: str = "v") -> DataFrame:
    """The largest value of each window, NaN above all, and its flat place in the image; the first place wins a tie."""
    cells, _ = _joined(df, axes, "i", "o")
    flat = reduce(lambda a, c: a * sizes[c] + F.col(c), axes, F.lit(0).cast("long"))
    best = F.max(F.struct(F.col(value).alias("v"), F.negative(flat).alias("p"))).alias("_b")
    return cells.groupBy(*ids, *[F.col(f"_{c}").alias(c) for c in axes]).agg(best).select(*ids, *axes, F.col("_b.v").alias(value), F.negative("_b.p").alias("at"))


def places(df: DataFrame, sizes: dict[str, int], at: str = "at") -> DataFrame:
    """Coordinates of a flat place."""
    out, stride = {}, 1
    for c, n in reversed(sizes.items()):
        out[c] = F.pmod(F.floor(F.col(at) / stride), F.lit(n)).cast("long")
        stride *= n
    return df.withColumns(out)


def max_pool_backward(grad: DataFrame, pooled: DataFrame, sizes: dict[str, int], ids: list[str], value: str = "v") -> DataFrame:
    """Gradients summed at the places that the windows' values came from."""
    hit = grad.join(pooled.select(*ids, *sizes, "at"), [*ids, *sizes]).groupBy(*ids, "at").agg(F.sum(value).alias(value))
    return places(hit, sizes).drop("at")


def max_unpool(pooled: DataFrame, sizes: dict[str, int], ids: list[str], value: str = "v") -> DataFrame:
    """An image of zeros with the pooled values at their places."""
    grid = pooled.select(*ids).distinct()
    for c, n in sizes.items():
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    hit = places(pooled.drop(*sizes), sizes).groupBy(*ids, *sizes).agg(F.max(value).alias(value))
    return grid.join(hit, [*ids, *sizes], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def _columns(df: DataFrame, axes: dict[str, tuple[DataFrame, int, int]], side: str, other: str) -> DataFrame:
    for c, (axis, _, _) in axes.items():
        df = df.join(axis.select(F.col(side).alias(c), F.col(other).alias(f"_{c}"), F.col("k").alias(f"_k{c}")), c)
    return df


def im2col(df: DataFrame, axes: dict[str, tuple[DataFrame, int, int]], ids: list[str]) -> DataFrame:
    """Each window as a column: k (place in the window) and l (window), both flat. axes: axis table, window, number of windows.
    Places outside the image hold zero and have no row."""
    cells = _columns(df, axes, "i", "o")
    k = reduce(lambda a, c: a * axes[c][1] + F.col(f"_k{c}"), axes, F.lit(0).cast("long"))
    at = reduce(lambda a, c: a * axes[c][2] + F.col(f"_{c}"), axes, F.lit(0).cast("long"))
    return cells.select(*ids, k.alias("k"), at.alias("l"), "v")


def col2im(cols: DataFrame, axes: dict[str, tuple[DataFrame, int, int]], ids: list[str]) -> DataFrame:
    """The image in which each cell is the sum of its places in all windows."""
    rows = places(cols.withColumnRenamed("l", "at"), {c: n for c, (_, _, n) in axes.items()}).drop("at")
    rows = places(rows.withColumnRenamed("k", "at"), {f"_q{c}": w for c, (_, w, _) in axes.items()}).drop("at")
    for c, (axis, _, _) in axes.items():
        rows = rows.join(axis.select(F.col("o").alias(c), F.col("k").alias(f"_q{c}"), F.col("i").alias(f"_i{c}")), [c, f"_q{c}"])
    return rows.groupBy(*ids, *[F.col(f"_i{c}").alias(c) for c in axes]).agg(F.sum("v").alias("v"))


def depthwise_conv(df: DataFrame, weight: DataFrame, axes: dict[str, DataFrame], ids: list[str], channel: str) -> DataFrame:
    """Each channel by a kernel of its own. weight: channel, a column a dimension with the place in the kernel, w (a model's)."""
    cells = df
    for c, axis in axes.items():
        cells = cells.join(axis.select(F.col("i").alias(c), F.col("o").alias(f"_{c}"), F.col("k").alias(f"_k{c}")), c)
    weight = weight.select(channel, *[F.col(c).alias(f"_k{c}") for c in axes], "w")
    cells = cells.join(weight, [channel, *[f"_k{c}" for c in axes]])
    return cells.groupBy(*ids, channel, *[F.col(f"_{c}").alias(c) for c in axes]).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def depthwise_conv_backward(grad: DataFrame, weight: DataFrame, axes: dict[str, DataFrame], ids: list[str], channel: str) -> DataFrame:
    """The input's gradient."""
    cells = grad
    for c, axis in axes.items():
        cells = cells.join(axis.select(F.col("o").alias(c), F.col("i").alias(f"_{c}"), F.col("k").alias(f"_k{c}")), c)
    weight = weight.select(channel, *[F.col(c).alias(f"_k{c}") for c in axes], "w")
    cells = cells.join(weight, [channel, *[f"_k{c}" for c in axes]])
    return cells.groupBy(*ids, channel, *[F.col(f"_{c}").alias(c) for c in axes]).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def depthwise_conv_weight_backward(df: DataFrame, grad: DataFrame, axes: dict[str, DataFrame], ids: list[str], channel: str) -> DataFrame:
    """The kernels' gradient: channel, a column a dimension with the place in the kernel, w. Each pair of an input and an output place that a tap joins
    adds to its tap; taps are few, so their sums are made before anything is shuffled by tap."""
    cells = df
    for c, axis in axes.items():
        cells = cells.join(axis.select(F.col("i").alias(c), F.col("o").alias(f"_{c}"), F.col("k").alias(f"_k{c}")), c)
    grad = grad.select(*ids, channel, *[F.col(c).alias(f"_{c}") for c in axes], F.col("v").alias("_g"))
    cells = cells.join(grad, [*ids, channel, *[f"_{c}" for c in axes]])
    return cells.groupBy(channel, *[F.col(f"_k{c}").alias(c) for c in axes]).agg(F.sum(F.col("v") * F.col("_g")).alias("w"))


# sampling at given places
def _corners(grid: DataFrame, sizes: dict[str, int], corners: bool, border: str, how: str) -> DataFrame:
    """grid rows (a column `at_<dim>` from -1 to 1 for each dimension) once for each cell that they read, with its weight in each dimension.
    border: zeros or border; how: bilinear or nearest."""
    for c, n in sizes.items():
        x = (F.col(f"at_{c}") + 1) / 2 * (n - 1) if corners else ((F.col(f"at_{c}") + 1) * n - 1) / 2
        x = F.least(F.greatest(x, F.lit(0.0)), F.lit(float(n - 1))) if border == "border" else x
        low = F.floor(x) if how == "bilinear" else F.rint(x).cast("long")
        grid = grid.withColumn(f"_x{c}", x).withColumn(f"_low{c}", low.cast("long"))
        each = F.explode(F.sequence(F.col(f"_low{c}"), F.col(f"_low{c}") + (1 if how == "bilinear" else 0)))
        grid = grid.withColumn(c, each).withColumn(f"_w{c}", 1 - F.abs(F.col(f"_x{c}") - F.col(c)) if how == "bilinear" else F.lit(1.0))
        grid = grid.withColumn(f"_s{c}", F.when(F.col(c) == F.col(f"_low{c}"), -1.0).otherwise(1.0))
    return grid


def grid_sample(df: DataFrame, grid: DataFrame, sizes: dict[str, int], ids: list[str], out: list[str], corners: bool = False, border: str = "zeros", how: str = "bilinear") -> DataFrame:
    """Values between cells at the grid's places. Cells outside the image are zero."""
    cells = _corners(grid, sizes, corners, border, how).join(df, [*ids, *sizes], "left")
    weight = reduce(lambda a, b: a * b, [F.col(f"_w{c}") for c in sizes])
    return cells.groupBy(*ids, *out).agg(F.sum(weight * F.coalesce("v", F.lit(0.0))).alias("v"))


def grid_sample_backward(grad: DataFrame, grid: DataFrame, sizes: dict[str, int], ids: list[str], out: list[str], corners: bool = False, border: str = "zeros", how: str = "bilinear") -> DataFrame:
    """The image's gradient: each read cell gets its weight of the gradient."""
    cells = _corners(grid, sizes, corners, border, how).join(grad.select(*ids, *out, F.col("v").alias("_g")), [*ids, *out])
    inside = reduce(lambda a, b: a & b, [F.col(c).between(0, n - 1) for c, n in sizes.items()])
    weight = reduce(lambda a, b: a * b, [F.col(f"_w{c}") for c in sizes])
    return cells.where(inside).groupBy(*ids, *sizes).agg(F.sum(weight * F.col("_g")).alias("v"))


def grid_sample_backward_grid(grad: DataFrame, df: DataFrame, grid: DataFrame, sizes: dict[str, int], ids: list[str], out: list[str], corners: bool = False) -> DataFrame:
    """The gradient of the grid's places (bilinear, zeros outside): at_<dim> for each dimension."""
    cells = _corners(grid, sizes, corners, "zeros", "bilinear").join(df, [*ids, *sizes]).join(grad.select(*ids, *out, F.col("v").alias("_g")), [*ids, *out])
    sums = []
    for c, n in sizes.items():
        others = reduce(lambda a, b: a * b, [F.col(f"_w{x}") for x in sizes if x != c], F.lit(1.0))
        sums.append((F.sum(F.col("_g") * F.col("v") * F.col(f"_s{c}") * others) * ((n - 1) / 2 if corners else n / 2)).alias(f"at_{c}"))
    return cells.groupBy(*ids, *out).agg(*sums)


# regions of interest
def roi_align(df: DataFrame, rois: DataFrame, height: int, width: int, out: int, samples: int, scale: float = 1.0, aligned: bool = True) -> DataFrame:
    """Mean of samples x samples interpolated values in each of out x out bins of each region. rois: roi, n, x1, y1, x2, y2."""
    cells = _roi_cells(rois, height, width, out, samples, scale, aligned)
    got = cells.join(df, ["n", "i", "j"]).groupBy("roi", "oi", "oj").agg(F.sum(F.col("_w") * F.col("v")).alias("v"))
    every = rois.select("roi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(out - 1).cast("long"))).alias("oi")).withColumn("oj", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(out - 1).cast("long"))))
    return every.join(got, ["roi", "oi", "oj"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def _length(lo: str, hi: str, scale: float, aligned: bool) -> Column:
    size = (F.col(hi) - F.col(lo)) * scale
    return size if aligned else F.greatest(size, F.lit(1.0))


def _roi_cells(rois: DataFrame, height: int, width: int, out: int, samples: int, scale: float, aligned: bool) -> DataFrame:
    """Each bin of each region once for each cell that it reads, with the weight."""
    shift = 0.5 if aligned else 0.0
    axis = lambda lo, hi, o, s: F.col(lo) * scale - shift + (F.col(o) + (F.col(s) + 0.5) / samples) * _length(lo, hi, scale, aligned) / out
    each = rois
    for c, n in (("oi", out), ("oj", out), ("_si", samples), ("_sj", samples)):
        each = each.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    each = each.withColumn("_y", axis("y1", "y2", "oi", "_si")).withColumn("_x", axis("x1", "x2", "oj", "_sj"))
    each = each.where(F.col("_y").between(-1, height) & F.col("_x").between(-1, width))
    for c, x, n in (("i", "_y", height), ("j", "_x", width)):
        at = F.least(F.greatest(F.col(x), F.lit(0.0)), F.lit(float(n - 1)))
        each = each.withColumn(x, at).withColumn(c, F.explode(F.array_distinct(F.array(F.floor(x), F.least(F.floor(x) + 1, F.lit(n - 1))))))
    weight = (1 - F.abs(F.col("_y") - F.col("i"))) * (1 - F.abs(F.col("_x") - F.col("j"))) / samples**2
    return each.withColumn("_w", weight)


def roi_align_backward(grad: DataFrame, rois: DataFrame, height: int, width: int, out: int, samples: int, scale: float = 1.0, aligned: bool = True) -> DataFrame:
    """grad: roi, oi, oj, v. What each cell of the images gets."""
    cells = _roi_cells(rois, height, width, out, samples, scale, aligned).join(grad, ["roi", "oi", "oj"])
    return cells.groupBy("n", "i", "j").agg(F.sum(F.col("_w") * F.col("v")).alias("v"))


def ps_roi_align(df: DataFrame, rois: DataFrame, height: int, width: int, out: int, samples: int, scale: float = 1.0) -> DataFrame:
    """Position-sensitive: bin (oi, oj) of output channel c reads input channel (c * out + oi) * out + oj. df: n, c, i, j, v."""

    def axis(bins: DataFrame, o: str, lo: str, hi: str, size: int) -> DataFrame:
        at = lambda s: F.col(lo) * scale - 0.5 + (F.col(o) + (s + 0.5) / samples) * _length(lo, hi, scale, True) / out
        inside = F.filter(F.transform(factor.upto(samples), at), lambda x: x.between(-1, size))
        bins = factor.held(bins, _x=F.transform(inside, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(float(size - 1)))))
        ends = F.flatten(F.transform("_x", lambda x: F.array(F.floor(x), F.least(F.floor(x) + 1, F.lit(size - 1)))))
        total = lambda i: F.aggregate("_x", F.lit(0.0), lambda a, x: a + F.when((i - F.floor(x)).between(0, 1), (1 - F.abs(x - i)) / samples).otherwise(0.0))
        return _weighed(bins, ends, lambda i: F.when((i < size) & F.exists("_x", lambda x: (i - F.floor(x)).between(0, 1)), total(i)))

    read = _read_bins(df, rois, axis, height, width, out)
    return read.groupBy("roi", "c", "oi", "oj").agg(F.sum(F.col("_w") * F.col("v")).alias("v"))


def _weighed(bins: DataFrame, cells: Column, weight: Callable[[Column], Column]) -> DataFrame:
    """bins for each tile _t that their cells of an axis lie in, with _w, the weights of the tile's cells: null for one that is not read."""
    bins = bins.withColumn("_t", F.explode(F.array_distinct(F.transform(cells, lambda i: F.floor(i / TILE).cast("long")))))
    return factor.held(bins, _w=F.transform(factor.upto(TILE), lambda k: weight(F.col("_t") * TILE + k)))


def _packed(df: DataFrame, out: int) -> DataFrame:
    """Images by channel in tiles: n, the tile, c, oi, oj and the cells' places and values. Rows that a batch holds of a tile go together before anything
    is shuffled; a tile's rows may come from several batches."""
    tile = lambda c: F.floor(F.col(c) / TILE).cast("long")
    place = (F.pmod("i", F.lit(TILE)) * TILE + F.pmod("j", F.lit(TILE))).cast("short")
    rows = df.select("n", "c", tile("i").alias("_ti"), tile("j").alias("_tj"), place.alias("_p"), F.col("v").cast("double").alias("v"))
    keys = ["n", "c", "_ti", "_tj"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("_p", "list"), ("v", "list")])
            yield from lists.select([*keys, "_p_list", "v_list"]).rename_columns([*keys, "_p", "v"]).to_batches()

    kind = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_p", T.ArrayType(T.ShortType())), T.StructField("v", T.ArrayType(T.DoubleType()))])
    packed = rows.mapInArrow(pack, kind)
    packed = packed.withColumn("oj", F.pmod(F.col("c"), F.lit(out)).cast("long")).withColumn("oi", F.pmod(F.floor(F.col("c") / out), F.lit(out)).cast("long"))
    return packed.withColumn("c", F.floor(F.col("c") / (out * out)).cast("long"))


def _read_bins(df: DataFrame, rois: DataFrame, axis: Callable[..., DataFrame], height: int, width: int, out: int) -> DataFrame:
    """roi, c, oi, oj, v and weight _w for each cell that a bin of a region reads of a channel of its own. axis: bins and their column along an axis, the
    region's ends and the axis' length to what _weighed gives. Regions and tiles of images meet by image, tile and bin, and cells come out after that.
    Spark takes both sides for short: they are told not to broadcast."""
    bins = rois.select("roi", "n", "x1", "y1", "x2", "y2")
    for o, t, w, lo, hi, size in (("oi", "_ti", "_wi", "y1", "y2", height), ("oj", "_tj", "_wj", "x1", "x2", width)):
        bins = bins.withColumn(o, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(out - 1).cast("long"))))
        bins = axis(bins, o, lo, hi, size).withColumnsRenamed({"_t": t, "_w": w})
    keys = ["n", "_ti", "_tj", "oi", "oj"]
    met = bins.select("roi", *keys, "_wi", "_wj").join(_packed(df, out).hint("merge"), keys)
    cells = met.select("roi", "c", "oi", "oj", "_wi", "_wj", F.inline(F.arrays_zip("_p", "v")).alias("_p", "v"))
    weight = F.get("_wi", F.floor(F.col("_p") / TILE).cast("int")) * F.get("_wj", (F.col("_p") % TILE).cast("int"))
    return cells.select("roi", "c", "oi", "oj", "v", weight.alias("_w")).where(F.col("_w").isNotNull())


def ps_roi_align_backward(grad: DataFrame, rois: DataFrame, height: int, width: int, out: int, samples: int, scale: float = 1.0) -> DataFrame:
    """grad: roi, c, oi, oj, v. What each cell of each input channel gets."""
    cells = _roi_cells(rois, height, width, out, samples, scale, True).join(grad, ["roi", "oi", "oj"])
    channel = ((F.col("c") * out + F.col("oi")) * out + F.col("oj")).alias("c")
    return cells.groupBy("n", channel, "i", "j").agg(F.sum(F.col("_w") * F.col("v")).alias("v"))


def _pool_cells(rois: DataFrame, height: int, width: int, out: int, scale: float, inclusive: bool) -> DataFrame:
    """Each bin of each region once for each whole cell in it; empty bins have no row. inclusive: the region's last cell counts. Spark takes a table
    that generators have made for as short as its source, so joins with these cells, or of images by channel, are told not to broadcast."""
    each = rois
    for c in ("oi", "oj"):
        each = each.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(out - 1).cast("long"))))
    for c, o, lo, hi, n in (("i", "oi", "y1", "y2", height), ("j", "oj", "x1", "x2", width)):
        low, top = _span(F.col(o), lo, hi, n, out, scale, inclusive)
        each = each.withColumn(c, F.explode(F.when(top > low, F.sequence(low, top - 1))))
    return each


def _span(o: Column, lo: str, hi: str, n: int, out: int, scale: float, inclusive: bool) -> tuple[Column, Column]:
    """The first cell of an axis in bin o, and the one after the last."""
    a, z = F.round(F.col(lo) * scale), F.round(F.col(hi) * scale)
    size = F.greatest(z - a + (1 if inclusive else 0), F.lit(1.0 if inclusive else 0.1)) / out
    low = F.least(F.greatest(F.floor(o * size) + a, F.lit(0)), F.lit(n)).cast("long")
    return low, F.least(F.greatest(F.ceil((o + 1) * size) + a, F.lit(0)), F.lit(n)).cast("long")


def roi_pool_backward(grad: DataFrame, df: DataFrame, rois: DataFrame, height: int, width: int, out: int, scale: float = 1.0) -> DataFrame:
    """grad: roi, oi, oj, v. Each bin's gradient goes to the cell that was its largest, the first of several."""
    cells = _pool_cells(rois, height, width, out, scale, True).join(df.hint("merge"), ["n", "i", "j"])
    best = cells.groupBy("roi", "n", "oi", "oj").agg(F.max(F.struct(F.col("v"), F.negative("i").alias("i"), F.negative("j").alias("j"))).alias("_b"))
    return best.join(grad, ["roi", "oi", "oj"]).groupBy("n", F.negative("_b.i").alias("i"), F.negative("_b.j").alias("j")).agg(F.sum(grad["v"]).alias("v"))


def ps_roi_pool(df: DataFrame, rois: DataFrame, height: int, width: int, out: int, scale: float = 1.0) -> DataFrame:
    """Means of the bins' whole cells, each bin of a channel of its own as in ps_roi_align."""

    def axis(bins: DataFrame, o: str, lo: str, hi: str, size: int) -> DataFrame:
        low, top = _span(F.col(o), lo, hi, size, out, scale, False)
        bins = factor.held(bins, _low=low, _top=top)
        cells = F.when(F.col("_top") > F.col("_low"), F.sequence(F.col("_low"), F.col("_top") - 1))
        return _weighed(bins, cells, lambda i: F.when((i >= F.col("_low")) & (i < F.col("_top")), 1.0))

    return _read_bins(df, rois, axis, height, width, out).groupBy("roi", "c", "oi", "oj").agg(F.avg("v").alias("v"))


def ps_roi_pool_backward(grad: DataFrame, rois: DataFrame, height: int, width: int, out: int, scale: float = 1.0) -> DataFrame:
    """grad: roi, c, oi, oj, v. Each cell of a bin gets its share of the bin's gradient, in the bin's own channel."""
    cells = _pool_cells(rois, height, width, out, scale, False)
    sizes = cells.groupBy("roi", "oi", "oj").agg(F.count("*").alias("_n"))
    moved = cells.join(sizes.join(grad.hint("merge"), ["roi", "oi", "oj"]).hint("merge"), ["roi", "oi", "oj"])
    channel = ((F.col("c") * out + F.col("oi")) * out + F.col("oj")).alias("c")
    return moved.groupBy("n", channel, "i", "j").agg(F.sum(F.col("v") / F.col("_n")).alias("v"))


def _sampled(df: DataFrame, offsets: DataFrame, sizes: dict[str, int], ids: list[str]) -> DataFrame:
    """One row for each tap of each output place and input channel: x, what it reads, and dy, dx, how that changes with its place. One corner of
    four is a row before the sums, which are made within the tap."""
    taps = offsets
    for c, x in (("i", "y"), ("j", "x")):
        taps = taps.withColumn(f"_low{c}", F.floor(x)).withColumn(c, F.explode(F.sequence(F.floor(x), F.floor(x) + 1))).withColumn(f"_w{c}", 1 - F.abs(F.col(x) - F.col(c)))
        taps = taps.withColumn(f"_s{c}", F.when(F.col(c) == F.col(f"_low{c}"), -1.0).otherwise(1.0))
    read = taps.join(df, [*ids, *sizes])
    total = lambda w, n: F.sum(w * F.col("v")).alias(n)
    wi, wj = F.col("_wi"), F.col("_wj")
    return read.groupBy(*ids, "oi", "oj", "k", "mask", "c").agg(total(wi * wj, "x"), total(F.col("_si") * wj, "dy"), total(F.col("_sj") * wi, "dx"))


def deform_conv_weight_backward(grad: DataFrame, df: DataFrame, offsets: DataFrame, sizes: dict[str, int], ids: list[str]) -> DataFrame:
    """The weight's gradient: o, c, k, w. grad: ids, o, oi, oj, v."""
    both = _sampled(df, offsets, sizes, ids).join(grad, [*ids, "oi", "oj"])
    return both.groupBy("o", "c", "k").agg(F.sum(F.col("v") * F.col("mask") * F.col("x")).alias("w"))


def deform_conv_tap_backward(grad: DataFrame, df: DataFrame, offsets: DataFrame, weight: DataFrame, sizes: dict[str, int], ids: list[str]) -> DataFrame:
    """The gradients of each tap's place (y, x) and mask: ids, oi, oj, k, y, x, mask. Output channels are summed first, by (output place, input
    channel, tap)."""
    pulled = grad.join(weight, "o").groupBy(*ids, "oi", "oj", "c", "k").agg(F.sum(F.col("v") * F.col("w")).alias("_g"))
    both = _sampled(df, offsets, sizes, ids).join(pulled, [*ids, "oi", "oj", "c", "k"])
    part = lambda c, *more: F.sum(F.col("_g") * F.col(c) * (F.col("mask") if more else 1.0))
    return both.groupBy(*ids, "oi", "oj", "k").agg(part("dy", 1).alias("y"), part("dx", 1).alias("x"), part("x").alias("mask"))


def deform_conv(df: DataFrame, offsets: DataFrame, weight: DataFrame, sizes: dict[str, int], ids: list[str]) -> DataFrame:
    """A convolution whose taps are moved: offsets has, for each output place (ids, oi, oj) and tap k, the place y, x that it reads, between cells,
    and a mask; weight (a model's): o, c, k, w. df: ids, c, i, j, v. Places outside are zero."""
    taps = offsets
    for c, x in (("i", "y"), ("j", "x")):
        taps = taps.withColumn(c, F.explode(F.sequence(F.floor(x), F.floor(x) + 1))).withColumn(f"_w{c}", 1 - F.abs(F.col(x) - F.col(c)))
    read = taps.join(df, [*ids, *sizes]).join(weight, ["c", "k"])
    return read.groupBy(*ids, "o", "oi", "oj").agg(F.sum(F.col("_wi") * F.col("_wj") * F.col("mask") * F.col("v") * F.col("w")).alias("v"))


def deform_conv_backward(grad: DataFrame, offsets: DataFrame, weight: DataFrame, sizes: dict[str, int], ids: list[str]) -> DataFrame:
    """The input's gradient. grad: ids, o, oi, oj, v."""
    taps = offsets
    for c, x in (("i", "y"), ("j", "x")):
        taps = taps.withColumn(c, F.explode(F.sequence(F.floor(x), F.floor(x) + 1))).withColumn(f"_w{c}", 1 - F.abs(F.col(x) - F.col(c))).where(F.col(c).between(0, sizes[c] - 1))
    moved = taps.join(grad, [*ids, "oi", "oj"]).join(weight, ["o", "k"])
    return moved.groupBy(*ids, "c", "i", "j").agg(F.sum(F.col("_wi") * F.col("_wj") * F.col("mask") * F.col("v") * F.col("w")).alias("v"))


def roi_pool(df: DataFrame, rois: DataFrame, height: int, width: int, out: int, scale: float = 1.0) -> DataFrame:
    """The largest value of each of out x out bins of each region, whose ends are rounded to cells; 0 for an empty bin."""
    each = rois
    for c in ("oi", "oj"):
        each = each.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(out - 1).cast("long"))))
    bins = []
    for c, o, lo, hi, n in (("i", "oi", "y1", "y2", height), ("j", "oj", "x1", "x2", width)):
        a, z = F.round(F.col(lo) * scale), F.round(F.col(hi) * scale)
        size = F.greatest(z - a + 1, F.lit(1.0)) / out
        low = F.least(F.greatest(F.floor(F.col(o) * size) + a, F.lit(0)), F.lit(n)).cast("long")
        top = F.least(F.greatest(F.ceil((F.col(o) + 1) * size) + a, F.lit(0)), F.lit(n)).cast("long")
        bins.append((c, low, top))
    for c, low, top in bins:
        each = each.withColumn(c, F.explode_outer(F.when(top > low, F.sequence(low, top - 1))))
    return each.join(df.hint("merge"), ["n", "i", "j"], "left").groupBy("roi", "oi", "oj").agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v"))


def nms(boxes: DataFrame, group: list[str], overlap: float) -> DataFrame:
    """The boxes (id, x1, y1, x2, y2, score) of each group, an image's, that greedy suppression keeps: from the highest score on, ties by id,
    a box goes if it overlaps one that stays by more than `overlap`. A group's boxes meet in one task, as arrays of numbers."""

    def keep(p):
        import numpy as np

        p = p.sort_values(["score", "id"], ascending=[False, True])
        x1, y1, x2, y2 = (p[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2"))
        area, alive = (x2 - x1) * (y2 - y1), np.ones(len(p), bool)
        for k in range(len(p)):
            if alive[k]:
                w = np.maximum(np.minimum(x2[k], x2[k + 1 :]) - np.maximum(x1[k], x1[k + 1 :]), 0)
                h = np.maximum(np.minimum(y2[k], y2[k + 1 :]) - np.maximum(y1[k], y1[k + 1 :]), 0)
                both = w * h
                alive[k + 1 :] &= ~(both > overlap * (area[k] + area[k + 1 :] - both))
        return p[alive]

    return boxes.groupBy(*group).applyInPandas(keep, boxes.schema)

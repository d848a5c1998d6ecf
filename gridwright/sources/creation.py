"""Tables from nothing: ranges, grids and constants. Each is made by the executors from a range of row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = "long"


def arange(spark: SparkSession, start: float, end: float, step: float = 1) -> DataFrame:
    """i, v: start, start + step, ... below end (above it for a negative step)."""
    n = max(0, -int(-((end - start) / step) // 1))
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * F.lit(step)).alias("v"))


def range_(spark: SparkSession, start: float, end: float, step: float = 1) -> DataFrame:
    """As arange, with the end where a step falls on it."""
    n = int((end - start) / step // 1) + 1
    return spark.range(max(n, 0)).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * F.lit(step)).alias("v"))


def linspace(spark: SparkSession, start: float, end: float, steps: int) -> DataFrame:
    """Both halves are counted from their own end, so both ends are exact."""
    step = (end - start) / (steps - 1) if steps > 1 else 0.0
    v = F.when(F.col("id") < steps / 2, F.lit(float(start)) + step * F.col("id")).otherwise(F.lit(float(end)) - step * (steps - 1 - F.col("id")))
    return spark.range(steps).select(F.col("id").alias("i"), (v if steps > 1 else F.lit(float(start))).alias("v"))


def logspace(spark: SparkSession, start: float, end: float, steps: int, base: float = 10.0) -> DataFrame:
    return linspace(spark, start, end, steps).withColumn("v", F.pow(F.lit(base), F.col("v")))


def grid(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    """All coordinates of a shape: one range over the number of cells, cut into coordinates."""
    cells = 1
    for n in sizes.values():
        cells *= n
    out, stride = {}, 1
    for c, n in reversed(sizes.items()):
        out[c] = F.pmod(F.floor(F.col("id") / stride), F.lit(n)).cast(LONG)
        stride *= n
    return spark.range(cells).select(*[out[c].alias(c) for c in sizes])


def full(spark: SparkSession, sizes: dict[str, int], value: float) -> DataFrame:
    """zeros, ones, fill; an `empty` table is one of zeros, for a table has no cell without a value."""
    return grid(spark, sizes).withColumn("v", F.lit(value))


def full_like(df: DataFrame, value: str, fill: float) -> DataFrame:
    """The same coordinates and another value: zeros_like, ones_like, empty_like, fill, zero."""
    return df.withColumn(value, F.lit(fill).cast(df.schema[value].dataType))


def eye(spark: SparkSession, n: int, m: int | None = None) -> DataFrame:
    """In coordinate form, with its zeros."""
    return grid(spark, {"i": n, "j": m or n}).withColumn("v", (F.col("i") == F.col("j")).cast("double"))


def triangle_indices(spark: SparkSession, rows: int, cols: int, offset: int = 0, upper: bool = False) -> DataFrame:
    """n, i, j: coordinates of a triangle, row by row; n is their number. Rows are ranges, numbered by how many cells the rows before them have."""
    i = F.col("id")
    first = F.least(F.greatest(i + offset, F.lit(0)), F.lit(cols)) if upper else F.lit(0).cast(LONG)
    end = F.lit(cols).cast(LONG) if upper else F.least(F.greatest(i + offset + 1, F.lit(0)), F.lit(cols))
    # cells of the rows before: sums of clipped runs, in closed form
    before = _clipped(i + offset, cols) - _clipped(F.lit(offset), cols)
    before = i * cols - before if upper else _clipped(i + offset + 1, cols) - _clipped(F.lit(offset + 1), cols)
    rows_ = spark.range(rows).select(i.alias("i"), first.alias("_a"), end.alias("_z"), before.alias("_n")).where("_z > _a")
    cells = rows_.select("i", "_n", "_a", F.explode(F.sequence(F.col("_a"), F.col("_z") - 1)).alias("j"))
    return cells.select((F.col("_n") + F.col("j") - F.col("_a")).cast(LONG).alias("n"), "i", F.col("j").cast(LONG).alias("j"))


def _clipped(x: Column, top: int) -> Column:
    """Sum of min(max(k, 0), top) for k below x (and not below 0)."""
    low = F.least(F.greatest(x, F.lit(0)), F.lit(top + 1)).cast(LONG)
    return F.floor(low * (low - 1) / 2) + F.greatest(x - top - 1, F.lit(0)) * top


def randperm(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """i, v: a permutation of 0 .. n - 1, each row ranked by a hash of its number."""
    from ..operators.relational import numbered

    rows = spark.range(n).select(F.col("id").alias("i"), F.xxhash64(F.lit(seed), "id").alias("_h"))
    return numbered(rows, "_h", "v").select("i", "v")

"""Reads and writes by index as equi-joins, and the gradients of lookups as sums by index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered
from .relational import by_key


def index(source: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Cells at wanted coordinates, in several dimensions at once."""
    return wanted.join(source, on)


def take(source: DataFrame, wanted: DataFrame, sizes: dict[str, int], flat: str) -> DataFrame:
    """Cells by their place in the flattened table; negative places count from its end."""
    cells = reduce(lambda a, n: a * n, sizes.values(), 1)
    place = reduce(lambda a, c: a * sizes[c] + F.col(c), sizes, F.lit(0).cast("long"))
    at = F.when(F.col(flat) < 0, F.col(flat) + cells).otherwise(F.col(flat))
    return wanted.withColumn("_at", at).join(source.withColumn("_at", place).drop(*sizes), "_at").drop("_at")


def put(target: DataFrame, source: DataFrame, on: list[str], value: str, accumulate: bool = False) -> DataFrame:
    """source: on, s, ordinal. Cells at its coordinates become its values, the last one by ordinal; or get their sum added. put, index_put,
    index_copy, scatter."""
    agg = F.sum("s") if accumulate else F.max_by("s", "ordinal")
    got = source.groupBy(*on).agg(agg.alias("_s"))
    new = F.col(value) + F.coalesce("_s", F.lit(0)) if accumulate else F.coalesce("_s", value)
    return target.join(got, on, "left").withColumn(value, new).drop("_s")


def fill(target: DataFrame, places: DataFrame, on: list[str], value: str, x: float) -> DataFrame:
    hit = places.select(*on).distinct().withColumn("_hit", F.lit(True))
    return target.join(hit, on, "left").withColumn(value, F.when(F.col("_hit"), F.lit(x)).otherwise(F.col(value))).drop("_hit")


def lookup_backward(grad: DataFrame, on: list[str], value: str, padding: Column | None = None, by_frequency: bool = False) -> DataFrame:
    """Gradient of gather, index_select and embedding: sums by index. Rows with a true padding count nothing; by_frequency divides by how often
    an index comes."""
    rows = grad if padding is None else grad.where(~padding)
    total = F.sum(value) / F.count("*") if by_frequency else F.sum(value)
    return rows.groupBy(*on).agg(total.alias(value))


def bag_backward(bags: DataFrame, grad: DataFrame, bag: str, on: list[str], mode: str = "sum", weight: str | None = None) -> DataFrame:
    """bags: bag, on, (weight); grad: bag, g. The table's gradient for bags that were summed or averaged."""
    rows = bags.join(grad, bag)
    if mode == "mean":
        rows = by_key(rows, [bag], [F.count("*").alias("_n")])
    share = F.col("g") * (F.col(weight) if weight else 1) / (F.col("_n") if mode == "mean" else 1)
    return rows.groupBy(*on).agg(F.sum(share).alias("g"))


def bag_weights_backward(bags: DataFrame, grad: DataFrame, table: DataFrame, bag: str, on: str, ordinal: str) -> DataFrame:
    """Gradient of each entry's own weight: its row times its bag's gradient. grad: bag, d, g; table: on, d, v."""
    return bags.join(table, on).join(grad, [bag, "d"]).groupBy(ordinal).agg(F.sum(F.col("v") * F.col("g")).alias("g"))


def masked_scatter(df: DataFrame, at: str, mask: str, value: str, source: DataFrame, source_at: str, source_value: str) -> DataFrame:
    """The masked rows' values become the source's, in order; a null mask is false, and masked rows past the source's end keep their values. Both are
    numbered in parts."""
    from .relational import numbered

    hit = F.coalesce(F.col(mask), F.lit(False))
    masked = numbered(df.where(hit), at, "_n")
    ranked = numbered(source.select(source_at, F.struct(F.col(source_value).alias("v")).alias("_s")), source_at, "_n").drop(source_at)
    both = masked.join(ranked, "_n", "left")
    return both.withColumn(value, F.when(F.col("_s").isNull(), F.col(value)).otherwise(F.col("_s.v"))).select(df.columns).unionByName(df.where(~hit))


def nonzero(df: DataFrame, dims: list[str], value: str = "v") -> DataFrame:
    return df.where((F.col(value) != 0) | F.isnan(F.col(value).cast("double"))).select(*dims)


def nonzero_static(df: DataFrame, at: str, value: str, size: int, fill: int = -1) -> DataFrame:
    """n, at: the first `size` places that aren't zero, filled up."""
    from .relational import numbered

    hit = numbered(nonzero(df, [at], value), at, "n").where(F.col("n") < size)
    return df.sparkSession.range(size).withColumnRenamed("id", "n").join(hit, "n", "left").withColumn(at, F.coalesce(at, F.lit(fill)))


def item(df: DataFrame, value: str):
    """The one value of a table of one row."""
    rows = df.select(value).take(2)
    if len(rows) != 1:
        raise ValueError("item needs a table of one row")
    return rows[0][0]


def equal(a: DataFrame, b: DataFrame, on: list[str], value: str = "v") -> DataFrame:
    """One row: whether both tables have the same coordinates and values; NaN equals nothing."""
    both = a.select(*on, F.col(value).alias("_a"), F.lit(True).alias("_ina")).join(b.select(*on, F.col(value).alias("_b"), F.lit(True).alias("_inb")), on, "full")
    same = F.coalesce((F.col("_a") == F.col("_b")) & ~F.isnan(F.col("_a").cast("double")), F.lit(False))
    return both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("equal"))


def same_size(a: DataFrame, b: DataFrame, dims: list[str]) -> DataFrame:
    """One row: whether both tables span the same shape."""
    ends = lambda df, n: df.agg(F.struct(*[F.max(c).alias(c) for c in dims]).alias(n))
    return ends(a, "_a").join(F.broadcast(ends(b, "_b"))).select(F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


def checked(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df; a row that breaks the condition fails the job."""
    return df.where(F.assert_true(condition, message).isNull())


def unique_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows over several columns, and how often each comes."""
    return df.groupBy(*columns).agg(F.count("*").alias("counts"))


def unique_rows_consecutive(df: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    from .relational import unique_consecutive

    runs = unique_consecutive(df.withColumn("_all", F.struct(*columns)), keys, at, "_all")
    return runs.select(*keys, "run", *[F.col(f"_all.{c}").alias(c) for c in columns], "counts", "start")


def segment_reduce(df: DataFrame, lengths: DataFrame, at: str, value: str, how: str, initial: float | None = None) -> DataFrame:
    """lengths: segment, n. A reduction of each run of n rows; empty segments give the initial value or what nothing gives. Segments are placed by a
    scan in ranges; each explodes its own places."""
    from .relational import global_scan

    edges = global_scan(lengths.select("segment", F.col("n").cast("long").alias("n")), "segment", _to=F.col("n"))
    rows = edges.where("n > 0").select("segment", F.explode(F.sequence(F.col("_to") - F.col("n"), F.col("_to") - 1)).alias(at)).join(df, at)
    odd = F.bool_or(F.isnan(F.col(value).cast("double")))
    agg = {"sum": F.sum(value), "mean": F.avg(value), "max": F.max(value), "min": F.when(odd, float("nan")).otherwise(F.min(value)), "prod": F.product(value)}[how]
    none = initial if initial is not None else {"sum": 0.0, "prod": 1.0, "mean": float("nan"), "max": float("-inf"), "min": float("inf")}[how]
    if initial is not None:
        agg = {"sum": agg + initial, "prod": agg * initial, "max": F.greatest(agg, F.lit(initial)), "min": F.least(agg, F.lit(initial)), "mean": agg}[how]
    return lengths.select("segment").join(rows.groupBy("segment").agg(agg.alias("v")), "segment", "left").withColumn("v", F.coalesce(F.col("v").cast("double"), F.lit(none)))


def segment_reduce_backward(df: DataFrame, grad: DataFrame, value: str, how: str) -> DataFrame:
    """df: segment, at, value; grad: segment, g. Extremes share their gradient among their ties."""
    rows = df.join(grad, "segment")
    if how == "sum":
        return rows.withColumn("d", F.col("g").cast("double")).drop("g")
    if how == "mean":
        return by_key(rows, ["segment"], [F.count("*").alias("_n")]).withColumn("d", F.col("g") / F.col("_n")).drop("g", "_n")
    if how == "prod":  # the product of the others: of all over the value, or of the rest where one value is 0
        rest = F.product(F.when(F.col(value) == 0, 1.0).otherwise(F.col(value)))
        total = by_key(rows, ["segment"], [rest.alias("_p"), F.count_if(F.col(value) == 0).alias("_z")])
        own = F.when(F.col("_z") == 0, F.col("_p") / F.when(F.col(value) == 0, 1.0).otherwise(F.col(value)))
        return total.withColumn("d", F.col("g") * own.when((F.col("_z") == 1) & (F.col(value) == 0), F.col("_p")).otherwise(0.0)).drop("g", "_p", "_z")
    rows = by_key(rows, ["segment"], [(F.max(value) if how == "max" else F.min(value)).alias("_m")]).withColumn("_hit", (F.col(value) == F.col("_m")).cast("long"))
    return by_key(rows, ["segment"], [F.sum("_hit").alias("_k")]).withColumn("d", F.when(F.col("_hit") == 1, F.col("g") / F.col("_k")).otherwise(0.0)).drop("g", "_m", "_hit", "_k")


def scatter_by_place(grad: DataFrame, keys: list[str], place: str, at: str, value: str) -> DataFrame:
    """Gradient of cummax and cummin: each place gets the sum of what came of it. Also of unfold, for windows exploded to their places."""
    return grad.groupBy(*keys, F.col(place).alias(at)).agg(F.sum(value).alias(value))


def cumprod_backward(df: DataFrame, keys: list[str], at: str, value: str, grad: str) -> DataFrame:
    """d: the gradient of each value in the running products. Before a group's first 0 it is what the later products bring, over the value; at the
    first 0, what the products without it bring up to the next 0; behind that, nothing. at: a number."""
    x, n = F.col(value), df.count()
    rows = ordered.scan(df, keys, [at], n_rows=n, _zeros=("sum", (x == 0).cast("long")))
    first = (F.col("_zeros") == 1) & (x == 0)
    rows = ordered.scan(rows, keys, [at], n_rows=n, _p=("product", F.when((F.col("_zeros") > 1) | first, 1.0).otherwise(x)))
    rows = rows.withColumn("_back", F.negative(at))
    rows = ordered.scan(rows, [*keys, "_zeros"], ["_back"], n_rows=n, _later=("sum", F.col(grad) * F.col("_p")))
    d = F.when(F.col("_zeros") == 0, F.col("_later") / F.when(x == 0, 1.0).otherwise(x)).when(first, F.col("_later")).otherwise(0.0)
    return rows.withColumn("d", d).select(*df.columns, "d")

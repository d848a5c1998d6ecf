"""Sparse matrices in coordinate form (i, j, v), and the compressed layouts as tables of pointers and places.

A compressed layout is two tables: pointers (one row a row, or column, and one for the end) and entries, numbered in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.creation import grid
from . import ordered
from .relational import global_cumsum


def to_sparse(dense: DataFrame) -> DataFrame:
    """The cells that aren't zero; NaN isn't."""
    return dense.where((F.col("v") != 0) | F.isnan(F.col("v").cast("double")))


def to_dense(m: DataFrame, rows: int, cols: int) -> DataFrame:
    """Every cell of the shape; those without an entry are zero. Repeated entries add up."""
    summed = m.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return grid(m.sparkSession, {"i": rows, "j": cols}).join(summed, ["i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def sparse_mask(dense: DataFrame, mask: DataFrame) -> DataFrame:
    """The values at the mask's coordinates, and zero where there is none. Also the gradient of to_dense."""
    return mask.select("i", "j").distinct().join(dense, ["i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def mask_projection(m: DataFrame, mask: DataFrame) -> DataFrame:
    """Sums of the entries that fall on the mask's coordinates."""
    return sparse_mask(m.groupBy("i", "j").agg(F.sum("v").alias("v")), mask)


def is_coalesced(m: DataFrame) -> DataFrame:
    """One row: whether no coordinates come twice."""
    counts = m.groupBy("i", "j").count()
    return counts.agg((F.coalesce(F.max("count"), F.lit(1)) == 1).alias("coalesced"))


def nnz(m: DataFrame) -> DataFrame:
    return m.agg(F.count("*").alias("nnz"))


def dims(m: DataFrame) -> tuple[int, int]:
    """Sparse dimensions (coordinate columns) and dense ones (nested arrays of the value)."""
    kind, depth = m.schema["v"].dataType.simpleString(), 0
    while kind.startswith("array<"):
        kind, depth = kind[6:-1], depth + 1
    return len(m.columns) - 1, depth


def indices(m: DataFrame) -> DataFrame:
    return m.select("i", "j")


def values(m: DataFrame) -> DataFrame:
    return m.select("v")


def empty_coo(spark) -> DataFrame:
    return spark.createDataFrame([], "i long, j long, v double")


def resize(m: DataFrame, rows: int, cols: int) -> DataFrame:
    """Another shape: entries outside it go."""
    return m.where((F.col("i") < rows) & (F.col("j") < cols))


def broadcast_to(m: DataFrame, name: str, size: int) -> DataFrame:
    """A new leading dimension along which the matrix repeats."""
    return m.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias(name), "*")


def pointers(m: DataFrame, on: str, size: int) -> DataFrame:
    """on, ptr: how many entries lie before each row (or column), and before the end."""
    n = m.groupBy(on).agg(F.count("*").alias("_n"))
    every = m.sparkSession.range(size + 1).withColumnRenamed("id", on).join(n, on, "left").select(on, F.coalesce("_n", F.lit(0)).alias("_n"))
    return global_cumsum(every, on, "_n").select(on, (F.col("cumsum") - F.col("_n")).alias("ptr"))


def entries(m: DataFrame, on: str, other: str) -> DataFrame:
    """n, other, v: entries by row (or column), then by the other coordinate; n is their number."""
    return ordered.numbered(m, [on, other]).select("n", other, "v")


def to_csr(m: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    return pointers(m, "i", rows), entries(m, "i", "j")


def to_csc(m: DataFrame, cols: int) -> tuple[DataFrame, DataFrame]:
    return pointers(m, "j", cols), entries(m, "j", "i")


def validate_compressed(ptr: DataFrame, rows: DataFrame, size: int, width: int, on: str = "i", other: str = "j") -> DataFrame:
    """One row: what must hold of pointers (on, ptr) and entries (n, other) of `size` rows and `width` columns, and how many entries there are."""
    before = ordered.previous(ptr, [], [on], "ptr").agg(
        F.coalesce(F.bool_and(F.when(F.col(on) == 0, F.col("ptr") == 0)), F.lit(False)).alias("first_is_zero"),
        F.max(F.when(F.col(on) == size, F.col("ptr"))).alias("_last"),
        F.coalesce(F.bool_and((F.col("ptr") - F.col("_previous.v")).between(0, width)), F.lit(True)).alias("rows_fit"),
        F.count("*").alias("_rows"),
    )
    starts = ptr.select(F.col("ptr").alias("n"), F.lit(True).alias("_start")).distinct()
    placed = ordered.previous(rows, [], ["n"], other).join(starts, "n", "left")
    held = placed.agg(
        F.count("*").alias("stored"),
        F.coalesce(F.bool_and(F.col(other).between(0, width - 1)), F.lit(True)).alias("columns_fit"),
        F.coalesce(F.bool_and(F.col("_start").isNotNull() | (F.col("_previous.v") < F.col(other))), F.lit(True)).alias("ascending"),
    )
    both = before.join(F.broadcast(held), F.lit(True))  # a row each
    last = F.coalesce((F.col("_last") == F.col("stored")) & (F.col("_rows") == size + 1), F.lit(False))
    return both.select("first_is_zero", last.alias("last_is_count"), "rows_fit", "columns_fit", "ascending", "stored")


def from_compressed(ptr: DataFrame, rows: DataFrame, on: str) -> DataFrame:
    """Coordinates again: each pointer's row, up to the next pointer, owns the entries between. Runs are exploded, not compared."""
    nxt = ptr.select((F.col(on) - 1).alias(on), F.col("ptr").alias("_to"))
    runs = ptr.join(nxt, on).where("_to > ptr").select(on, F.explode(F.sequence(F.col("ptr"), F.col("_to") - 1)).alias("n"))
    return runs.join(rows, "n").drop("n")


def blocks(m: DataFrame, height: int, width: int) -> DataFrame:
    """bi, bj, block: the blocks with any entry, row by row as arrays. BSR is their pointers and entries by bi, BSC those by bj."""
    place = F.pmod(F.col("i"), F.lit(height)) * width + F.pmod(F.col("j"), F.lit(width))
    cells = m.groupBy(F.floor(F.col("i") / height).alias("bi"), F.floor(F.col("j") / width).alias("bj"), place.alias("_p")).agg(F.sum("v").alias("v"))
    held = cells.groupBy("bi", "bj").agg(F.map_from_entries(F.collect_list(F.struct("_p", "v"))).alias("_m"))
    at = F.sequence(F.lit(0).cast("long"), F.lit(height * width - 1).cast("long"))
    return held.select("bi", "bj", F.transform(at, lambda p: F.coalesce(F.element_at("_m", p), F.lit(0))).alias("block"))


def to_bsr(m: DataFrame, height: int, width: int, rows: int) -> tuple[DataFrame, DataFrame]:
    b = blocks(m, height, width).select(F.col("bi").alias("i"), F.col("bj").alias("j"), F.col("block").alias("v"))
    return to_csr(b, -(-rows // height))


def to_bsc(m: DataFrame, height: int, width: int, cols: int) -> tuple[DataFrame, DataFrame]:
    b = blocks(m, height, width).select(F.col("bi").alias("i"), F.col("bj").alias("j"), F.col("block").alias("v"))
    return to_csc(b, -(-cols // width))


def row_sums(m: DataFrame, on: str = "i") -> DataFrame:
    return m.groupBy(on).agg(F.sum("v").alias("v"))


def row_products(m: DataFrame, on: str = "i") -> DataFrame:
    return m.groupBy(on).agg(F.product("v").alias("v"))


def sum_backward(grad: DataFrame, m: DataFrame, on: str = "i") -> DataFrame:
    """Each entry's gradient is that of its sum."""
    return m.select("i", "j").join(grad.select(on, "v"), on)


def softmax(m: DataFrame, on: str = "i") -> DataFrame:
    """Over the entries of each row; cells without an entry count as minus infinity."""
    from .relational import softmax as dense

    return dense(m, [on], "v")


def softmax_backward(grad: DataFrame, out: DataFrame, on: str = "i", log: bool = False) -> DataFrame:
    """grad: i, j, g; out: i, j, y, the forward result."""
    rows = out.join(grad, ["i", "j"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    total = rows.groupBy(on).agg(F.sum(F.col("g") if log else F.col("g") * F.col("y")).alias("_s"))
    v = F.col("g") - F.exp("y") * F.col("_s") if log else F.col("y") * (F.col("g") - F.col("_s"))
    return rows.join(total, on).select("i", "j", v.alias("v"))

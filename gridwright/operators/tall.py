"""Factors of tall tables (a row of n numbers each) and of large matrices in blocks.

A tall table's R comes from a tree: each task folds its rows, some at a time, into one upper triangle by Householder reflections, and triangles are folded
in two more levels. What travels is n^2 numbers a task; no row is shuffled. Q is the rows solved against R; as that loses orthogonality where the table
is ill-conditioned, its own R is found and solved for once more, which makes it orthogonal to rounding. Singular values are those of R.

R, n^2 numbers, goes to every task: n is bounded by MOST_COLUMNS. Columns that depend on those before them have a zero on R's diagonal and a zero
column in Q. Rows that are null or of another length than the first are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import factor
from .grid import vectors
from .linalg import solve_triangular

MOST_COLUMNS = 2048
#: Numbers that are reflected at a time, and tasks of the middle level.
CHUNK, MIDDLE = 1 << 19, 32


def triangle(a: np.ndarray) -> np.ndarray:
    """R of a, its diagonal not negative."""
    a = a.astype(float, copy=True)
    n = a.shape[1]
    for k in range(min(a.shape)):
        x = a[k:, k]
        rest = x[1:] @ x[1:]
        if rest:
            beta = -np.copysign(np.sqrt(x[0] * x[0] + rest), x[0])
            v = x / (x[0] - beta)
            v[0] = 1.0
            a[k:, k + 1 :] -= np.outer((beta - x[0]) / beta * v, v @ a[k:, k + 1 :])
            a[k, k], a[k + 1 :, k] = beta, 0.0
    r = np.zeros((n, n))
    r[: min(len(a), n)] = np.triu(a[:n])
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    if column.null_count or (np.diff(column.offsets.to_numpy()) != n).any():
        raise ValueError(f"each row needs {n} numbers")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, n)


def _fold(n: int, first: np.ndarray | None = None):
    """Arrow function: rows of n numbers in, the n rows of one triangle out. first: an R that rows are solved against before they are folded, in the same
    worker: a step of its own would keep a second one beside it in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, step = None, max(CHUNK // n, 2 * n)
        for batch in batches:
            rows = _matrix(batch.column(0), n)
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                part = part if first is None else _solved(part, first)
                r = triangle(part if r is None else np.vstack([r, part]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array(r.tolist(), pa.list_(pa.float64()))], ["row"])

    return run


def _width(df: DataFrame, vector: str) -> int:
    first = df.select(F.size(vector)).head()
    n = first[0] if first else 0
    if n > MOST_COLUMNS:
        raise ValueError(f"{n} columns are over {MOST_COLUMNS}")
    return n


def tall_r(df: DataFrame, vector: str, first: np.ndarray | None = None) -> np.ndarray:
    """R (n x n, diagonal not negative) of the table whose rows are the arrays of a column. first: an R that they are solved against before that."""
    n = _width(df, vector)
    if not n:
        return np.zeros((0, 0))
    out = df.select(F.col(vector).cast("array<double>").alias("row")).mapInArrow(_fold(n, first), "row array<double>")
    for tasks in (MIDDLE, 1):
        out = out.repartition(tasks).mapInArrow(_fold(n), "row array<double>")
    return np.array([r.row for r in out.collect()]).reshape(-1, n)  # one triangle, whose rows come in order from one task


def _solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x with x r = rows; 0 in the places of a zero diagonal."""
    x = np.zeros_like(rows)
    small = np.abs(np.diag(r)).max(initial=0.0) * len(r) * np.finfo(float).eps
    for j in range(len(r)):
        if abs(r[j, j]) > small:
            x[:, j] = (rows[:, j] - x[:, :j] @ r[:j, j]) / r[j, j]
    return x


def _each(df: DataFrame, vector: str, name: str, n: int, turn) -> DataFrame:
    """df with turn(its rows of numbers) as a further column. The optimiser doesn't copy what isn't deterministic: where the column is exploded, the filter
    that it makes of it would else compute it in a second worker of each task."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield vectors(turn(_matrix(x, n)))

    return df.withColumn(name, run.asNondeterministic()(F.col(vector).cast("array<double>")))


def tall_qr(df: DataFrame, vector: str, name: str = "q") -> tuple[DataFrame, np.ndarray]:
    """df with its row of Q, and R."""
    n = _width(df, vector)
    if not n:
        return df.withColumn(name, F.lit(None).cast("array<double>")), np.zeros((0, 0))
    first = tall_r(df, vector)
    second = tall_r(df, vector, first)
    return _each(df, vector, name, n, lambda rows: _solved(_solved(rows, first), second)), second @ first


def _as_row(df: DataFrame, r: np.ndarray) -> DataFrame:
    return df.sparkSession.createDataFrame([(r.tolist(),)], "r array<array<double>>")


def tall_lstsq(df: DataFrame, vector: str, targets: list[Column]) -> DataFrame:
    """target, x: for each target the x with the least squares of rows . x - target. R of the table with the targets beside it holds all that is needed."""
    n = _width(df, vector)
    wide = df.select(F.concat(F.col(vector).cast("array<double>"), F.array(*[t.cast("double") for t in targets])).alias("_row"))
    r = tall_r(wide, "_row")
    table = _as_row(df, r[:n]).select(
        F.transform("r", lambda x: F.slice(x, 1, n)).alias("a"), F.posexplode(F.transform(factor.upto(len(targets)), lambda t: F.transform("r", lambda x: F.get(x, t + n)))).alias("target", "b")
    )
    return table.select("target", solve_triangular(F.col("a"), F.col("b"), True).alias("x"))


def tall_svd(df: DataFrame, vector: str, name: str = "u") -> tuple[DataFrame, list[float], list[list[float]]]:
    """df with its row of U, the singular values (descending), and V (a vector for each value)."""
    n = _width(df, vector)
    found = _as_row(df, tall_r(df, vector)).select(factor.svd(F.col("r")).alias("s")).head()[0]
    values, v = np.array(found["values"]), np.array(found["v"])
    small = values.max(initial=0.0) * n * np.finfo(float).eps
    turn = np.where(values > small, 1 / np.where(values > small, values, 1.0), 0.0) * v.T
    return _each(df, vector, name, n, lambda rows: rows @ turn), values.tolist(), v.tolist()


# large definite matrices in coordinates
def block_cholesky(m: DataFrame, size: int, width: int = 64) -> DataFrame:
    """i, j, v of the lower L with L L^T = m (i, j, v; its lower triangle is read), in blocks of `width`: a diagonal block is factored, its panel solved
    against it, and the blocks behind lose the products of the panel, joined by block row and block column. Each step's blocks are a written table."""
    scratch = Scratch(m.sparkSession)
    place = [F.floor(F.col(c) / width).cast("int").alias(f"b{c}") for c in "ij"]
    cells = m.where(F.col("j") <= F.col("i")).select(*place, F.pmod("i", F.lit(width)).cast("int").alias("r"), F.pmod("j", F.lit(width)).cast("int").alias("c"), F.col("v").cast("double").alias("v"))
    # a diagonal block's upper half mirrors its lower one, and places beyond the end are those of the unit matrix
    mirror = cells.where((F.col("bi") == F.col("bj")) & (F.col("r") != F.col("c"))).select("bi", "bj", F.col("c").alias("r"), F.col("r").alias("c"), "v")
    n_blocks = -(-size // width)
    held = cells.unionByName(mirror).groupBy("bi", "bj").agg(F.map_from_entries(F.collect_list(F.struct(F.col("r") * width + F.col("c"), "v"))).alias("_m"))
    held = held.join(_block_grid(m, n_blocks), ["bi", "bj"], "right")
    beyond = lambda i: F.col("bi") * width + i >= size
    cell = lambda i, j: F.coalesce(F.try_element_at("_m", (i * width + j).cast("int")), F.when((F.col("bi") == F.col("bj")) & (i == j) & beyond(i), 1.0).otherwise(0.0))
    blocks = held.select("bi", "bj", F.transform(factor.upto(width), lambda i: F.transform(factor.upto(width), lambda j: cell(i, j))).alias("m"))
    blocks, done = scratch.save(blocks, "step"), []
    for k in range(n_blocks):
        top = blocks.where((F.col("bi") == k) & (F.col("bj") == k)).select("bi", "bj", factor.cholesky(F.col("m")).alias("m"))
        panel = blocks.where((F.col("bi") > k) & (F.col("bj") == k)).join(F.broadcast(top.select(F.col("bj"), F.col("m").alias("_l"))), "bj")
        panel = panel.select("bi", "bj", F.transform("m", lambda row: solve_triangular(F.col("_l"), row, False)).alias("m"))
        column = scratch.save(top.unionByName(panel), f"column{k}")
        done.append(column)
        if k + 1 < n_blocks:
            below = column.where(F.col("bi") > k)
            left, right = below.select("bi", F.col("m").alias("_a")), below.select(F.col("bi").alias("bj"), F.col("m").alias("_b"))
            rest = blocks.where(F.col("bj") > k).join(left, "bi").join(right, "bj")
            less = F.transform("m", lambda row, i: F.zip_with(row, F.transform("_b", lambda b: factor.dot(F.get(F.col("_a"), i), b)), lambda x, y: x - y))
            blocks = scratch.save(rest.select("bi", "bj", less.alias("m")), f"step{k}")
    out = done[0]
    for column in done[1:]:
        out = out.unionByName(column)
    flat = out.select("bi", "bj", F.posexplode("m").alias("r", "row")).select("bi", "bj", "r", F.posexplode("row").alias("c", "v"))
    flat = flat.select((F.col("bi") * width + F.col("r")).cast("long").alias("i"), (F.col("bj") * width + F.col("c")).cast("long").alias("j"), "v")
    return flat.where((F.col("i") < size) & (F.col("j") <= F.col("i")))


def _block_grid(m: DataFrame, n: int) -> DataFrame:
    rows = m.sparkSession.range(n).select(F.col("id").cast("int").alias("bi"))
    return rows.select("bi", F.explode(F.sequence(F.lit(0), F.col("bi"))).alias("bj"))

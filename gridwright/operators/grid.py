"""Rows against rows: both sides are dealt into blocks, Spark brings each pair of blocks together, and arrays of numbers work on one pair.

A task holds two blocks and a strip of the pairs' numbers, whatever the tables' size. Each side is shuffled once, and a pair's task reads its two blocks;
with keys, each side is shuffled once for each block of the other."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a block, and pairs that are worked on at once.
ROWS, STRIP = 2048, 1 << 16


def largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _blocks(df: DataFrame, keys: list[str], rows: int) -> int:
    return max(1, -(-largest(df, keys) // rows))


def meet(left: DataFrame, right: DataFrame, keys: list[str], work: Callable, kind: StructType, rows: int | None = None, once: bool = False) -> DataFrame:
    """Rows that `work` gives for each pair of a block of left and one of right with equal keys; null keys meet nothing. work: (left, right, same) as
    Arrow tables to an iterator of batches, same being whether the blocks have one number. once: left and right are the same rows, and of a pair of
    different blocks and its mirror only one is made."""
    rows = rows or ROWS
    for k in keys:
        left, right = left.where(F.col(k).isNotNull()), right.where(F.col(k).isNotNull())
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of their own, where both sides are one table
    n, m = _blocks(left, keys, rows), _blocks(right, keys, rows)
    own = lambda df, count: F.pmod(F.xxhash64(*df.columns), F.lit(count)).cast("int")
    if not keys:
        return crossed(left.withColumn("_b", own(left, n)), right.withColumn("_b", own(right, m)), n, m, work, kind, once)
    every = lambda first, last: F.explode(F.sequence(first, last))
    zero = F.lit(0)
    a = left.withColumn("_b", own(left, n)).withColumn("_c", every(F.col("_b") if once else zero, F.lit(m - 1)))
    b = right.withColumn("_c", own(right, m)).withColumn("_b", every(zero, F.col("_c") if once else F.lit(n - 1)))

    def pair(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return none.empty_table()
        got = list(work(x, y, x["_b"][0] == x["_c"][0]))
        return pa.Table.from_batches(got).cast(none) if got else none.empty_table()

    none = to_arrow_schema(kind)
    at = [*keys, "_b", "_c"]
    return a.groupBy(*at).cogroup(b.groupBy(*at)).applyInArrow(pair, kind)


def crossed(left: DataFrame, right: DataFrame, n: int, m: int, work: Callable, kind: StructType, once: bool = False) -> DataFrame:
    """As meet, for sides whose column _b is the number of a row's block, of n and of m. A block is one row of a partition of its own, and the pairs are
    Spark's product of partitions: each reads two blocks where they lie, so the disk holds each side once."""

    def whole(df: DataFrame, count: int, b: str, e: str) -> DataFrame:
        held = F.collect_list(F.struct(*[c for c in df.columns if c != "_b"]))
        return df.repartitionById(count, "_b").groupBy("_b").agg(held.alias(e)).withColumnRenamed("_b", b)

    none = to_arrow_schema(kind)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for r in range(len(held)):
                b, x, c, y = (held[name].slice(r, 1) for name in ("_b", "_x", "_c", "_y"))
                for got in work(*(pa.Table.from_struct_array(s.flatten()) for s in (x, y)), b[0] == c[0]):
                    yield from pa.Table.from_batches([got]).cast(none).to_batches()

    product = whole(left, n, "_b", "_x").hint("shuffle_replicate_nl").crossJoin(whole(right, m, "_c", "_y"))
    return (product.where("_b <= _c") if once else product).mapInArrow(pairs, kind)


def strips(n: int, m: int) -> Iterator[slice]:
    """Slices of n rows that meet m others, some STRIP pairs each."""
    step = max(1, STRIP // max(m, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def matrix(column: pa.ChunkedArray, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as rows of numbers, filled up with zeros, and which of them are there."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = pc.cast(lists.flatten(), pa.float64())
    width = max(width, int(sizes.max(initial=0)))
    placed = np.arange(width) < sizes[:, None]
    out, known = np.zeros((len(sizes), width)), np.zeros((len(sizes), width), bool)
    out[placed] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    known[placed] = flat.is_valid().to_numpy(zero_copy_only=False)
    return out, known


def both(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Two columns of lists as matrices of one width."""
    x, y = matrix(a), matrix(b)
    width = max(x[0].shape[1], y[0].shape[1])
    wide = lambda m: tuple(np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in m)
    return wide(x), wide(y)


def vectors(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width) if width else np.zeros(n + 1), pa.int32()), pa.array(rows.ravel(), pa.float64()))


def batch(names: list[str], *columns) -> pa.RecordBatch:
    plain = lambda c: pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    return pa.RecordBatch.from_arrays([plain(c) for c in columns], names=names)


def distances(x: np.ndarray, y: np.ndarray, p: float) -> np.ndarray:
    """p-distances from each row of x to each of y: summed place by place, from differences."""
    out = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T, strict=True):
        gap = np.abs(a[:, None] - b)
        if math.isinf(p):
            np.maximum(out, gap, out=out)
        elif p == 0:
            out += gap != 0
        else:
            out += gap if p == 1 else gap * gap if p == 2 else gap**p
    return out if p in (0, 1) or math.isinf(p) else np.sqrt(out) if p == 2 else out ** (1 / p)


def slopes(x: np.ndarray, y: np.ndarray, d: np.ndarray, p: float, ok: np.ndarray, other: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the sum of the distances d that are ok: of x and, if other is set, of y. A distance of 0 has none."""
    gx, gy = np.zeros(x.shape), np.zeros(y.shape)
    fine = ok & (d != 0)
    weight = np.where(fine, 1.0, 0.0) if p == 1 else fine / np.where(d == 0, 1.0, d) ** (1.0 if p == 2 or math.isinf(p) else p - 1.0)
    for c, (a, b) in enumerate(zip(x.T, y.T, strict=True)):
        gap = a[:, None] - b
        if p == 2:
            gap *= weight
        elif p == 1:
            gap = np.sign(gap) * weight
        elif math.isinf(p):
            gap = np.where(fine & (np.abs(gap) == d), np.sign(gap), 0.0)
        else:
            gap = np.sign(gap) * np.abs(gap) ** (p - 1.0) * weight
        gx[:, c] = gap.sum(1)
        if other:
            gy[:, c] = -gap.sum(0)
    return gx, gy

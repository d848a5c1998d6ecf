"""Exact selection by histograms of digits: the k-th row of each group without sorting a large group.

Values become order-preserving 64-bit numbers. For groups of over LARGE rows a pass counts the rows by 16 bits of the number, from the highest on, in two
steps (65,536 counts a group at most); the running count says which digit holds the k-th row, and the next pass looks at the rows with that prefix alone.
Four passes fix the value; where several rows have it, four more on their positions fix the row. Smaller groups are ranked by a window.

The table of large groups is broadcast: it has a row for each LARGE rows of the table at most, and no more than MOST; beyond that, and for
values without such a number (texts), rows are ranked in the parts of `ordered`, where no group is in one task either.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import ordered
from .ordered import match

LARGE = 1 << 20
MOST = 1 << 18
DIGIT = 16
LOWEST = -(1 << 63)


@F.arrow_udf(LongType())
def _float_order(x: pa.Array) -> pa.Array:
    """Bits of doubles, negative ones turned round; both zeros alike, NaN above all."""
    v = pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False) + 0.0
    v = np.where(np.isnan(v), np.nan, v)
    bits = np.ascontiguousarray(v, np.float64).view(np.int64)
    bits = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    return pa.array(bits, pa.int64(), mask=pc.is_null(x).to_numpy(zero_copy_only=False))


def order_number(df: DataFrame, name: str) -> Column | None:
    """A long that orders as the column does, nulls first; None for types that have none."""
    kind, c = dict(df.dtypes)[name], F.col(name)
    if kind in ("double", "float"):
        number = _float_order(c.cast("double"))
    elif kind in ("bigint", "int", "smallint", "tinyint", "boolean"):
        number = c.cast("long")
    elif kind == "date":
        number = F.unix_date(c).cast("long")
    elif kind in ("timestamp", "timestamp_ntz"):
        number = F.unix_micros(c.cast("timestamp"))
    else:
        return None
    return F.coalesce(number, F.lit(LOWEST))


def select(df: DataFrame, keys: list[str], value: str, at: str, want: Callable[[Column, Column], Column], large: int = LARGE) -> DataFrame:
    """The row of each group whose rank by (value, at), from 1, is want(rows of the group, those of them that are NaN); no row where the rank isn't
    one. `at` tells rows of a group apart."""
    nan = F.isnan(value) if dict(df.dtypes)[value] in ("double", "float") else F.lit(False)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"), F.count_if(nan).alias("_nan"))
    sizes = sizes.select(*keys, "_size", want(F.col("_size"), F.col("_nan")).cast("long").alias("_want"))
    numbers = [order_number(df, c) for c in (value, at)]
    big = sizes.where((F.col("_size") > large) & F.col("_want").between(1, F.col("_size")))
    n_big = big.count()
    if not n_big:
        return _ranked(df, sizes, keys, value, at)
    if n_big > MOST or any(n is None for n in numbers):
        ranks = match(ordered.numbered(df, [value, at], "_rank", keys), sizes, keys, "inner")
        return ranks.where(F.col("_rank") + 1 == F.col("_want")).select(*df.columns)
    names = F.broadcast(sizes.where(F.col("_size") > large).select(*keys))
    small = match(df, names.withColumn("_large", F.lit(True)), keys).where("_large is null").drop("_large")
    rows = df.withColumns({"_h": numbers[0], "_t": numbers[1]})
    chosen = _narrow(_narrow(big.select(*keys, "_want"), rows, keys, "_h", []), rows, keys, "_t", ["_h"])
    picked = match(rows, F.broadcast(chosen.select(*keys, F.col("_h").alias("_ph"), F.col("_t").alias("_pt"))), keys, "inner")
    picked = picked.where((F.col("_h") == F.col("_ph")) & (F.col("_t") == F.col("_pt"))).select(*df.columns)
    return picked.unionByName(_ranked(small, sizes, keys, value, at))


def _ranked(df: DataFrame, sizes: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value, at))
    return match(df.withColumn("_rank", rank), sizes, keys, "inner").where(F.col("_rank") == F.col("_want")).select(*df.columns)


def _narrow(state: DataFrame, rows: DataFrame, keys: list[str], number: str, fixed: list[str]) -> DataFrame:
    """state (keys, _want, fixed numbers) with the number of the wanted row, found digit by digit, and the rank left among its equals."""
    state = state.withColumn(number, F.lit(0).cast("long"))
    free = F.col(number).bitwiseXOR(F.lit(LOWEST))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        told = state.withColumnsRenamed({c: f"_p{c}" for c in (*fixed, number)})
        found = match(rows, F.broadcast(told), keys, "inner")
        for c in fixed:
            found = found.where(F.col(c) == F.col(f"_p{c}"))
        if shift + DIGIT < 64:
            found = found.where(F.shiftrightunsigned(free, shift + DIGIT) == F.shiftrightunsigned(F.col(f"_p{number}"), shift + DIGIT))
        digit = F.shiftrightunsigned(free, shift).bitwiseAND((1 << DIGIT) - 1)
        kept = [*keys, "_want", *[f"_p{c}" for c in (*fixed, number)]]
        counts = found.groupBy(*kept, digit.alias("_d")).agg(F.count("*").alias("_n"))
        counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_d")))
        hit = counts.where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        state = hit.select(
            *keys, (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_want"), *[F.col(f"_p{c}").alias(c) for c in fixed],
            F.col(f"_p{number}").bitwiseOR(F.shiftleft(F.col("_d"), shift)).alias(number),
        )
    return state.withColumn(number, free)

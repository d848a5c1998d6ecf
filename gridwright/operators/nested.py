"""Ragged arrays (an array of its own length in each row) and their dense and jagged forms, and quantised columns with their parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ragged arrays
def to_padded(a: Column, width, fill: float = 0.0) -> Column:
    """Longer arrays are cut, shorter ones filled."""
    width = width if isinstance(width, Column) else F.lit(width)
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill), F.greatest(width - F.size(a), F.lit(0)))), 1, width)


def widest(df: DataFrame, column: str) -> DataFrame:
    """One row: the greatest length, `width`."""
    return df.agg(F.max(F.size(column)).alias("width"))


def from_padded(a: Column, length: Column) -> Column:
    """The first `length` places."""
    return F.slice(a, 1, length)


def from_mask(a: Column, mask: Column) -> Column:
    """The places whose mask is true."""
    return F.filter(a, lambda x, i: F.get(mask, i))


def left_aligned(mask: Column) -> Column:
    """Whether the true places come before all others."""
    return F.coalesce(F.array_position(mask, False), F.lit(0)) * F.size(F.filter(mask, lambda x: x)) == F.when(F.array_contains(mask, False), F.array_position(mask, False) * (F.array_position(mask, False) - 1)).otherwise(0)


def sizes(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("size", F.size(column).cast("long"))


def offsets(df: DataFrame, order: str, column: str) -> DataFrame:
    """Where each array begins in the buffer that holds them one after another, in the order of a column."""
    from .relational import global_scan

    n = F.size(column).cast("long")
    return global_scan(df, order, _end=n).withColumn("offset", F.col("_end") - n).drop("_end")


def view_from_buffer(buffer: DataFrame, at: str, rows: DataFrame, order: str) -> DataFrame:
    """Arrays again, from a buffer (at, v) and rows with offset and size. Each row explodes its own places."""
    places = rows.where("size > 0").select(order, F.posexplode(F.sequence(F.col("offset"), F.col("offset") + F.col("size") - 1)).alias("_k", at))
    held = places.join(buffer, at).groupBy(order).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "v"))), lambda s: s["v"]).alias("a"))
    return rows.select(order).join(held, order, "left").withColumn("a", F.coalesce("a", F.expr("array()")))


def jagged_to_padded(df: DataFrame, keys: list[str], at: str, value: str, width: int, fill: float = 0.0) -> DataFrame:
    """A long table of ragged rows as a dense one: places up to width, filled."""
    every = df.select(*keys).distinct().withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
    return every.join(df.select(*keys, at, value), [*keys, at], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def softmax(a: Column) -> Column:
    """Of each array."""
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def select_backward(grad: Column, length: Column, index: int) -> Column:
    """Zeros but for the place that was selected."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when(i == index, grad).otherwise(0.0))


def with_dense(a: Column, x: Column, op) -> Column:
    """A ragged array and a number of its row: add, mul."""
    return F.transform(a, lambda v: op(v, x))


# quantisation
def qparams(low: Column, high: Column, bits_low: int = -128, bits_high: int = 127) -> tuple[Column, Column]:
    """Scale and zero point for a range of values, which is widened to hold 0."""
    low, high = F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))
    scale = F.greatest((high - low) / (bits_high - bits_low), F.lit(1e-12))
    return scale, F.least(F.greatest(bits_low - F.rint(low / scale), F.lit(bits_low)), F.lit(bits_high)).cast("int")


def quantize(x: Column, scale: Column, zero: Column, low: int = -128, high: int = 127) -> Column:
    """x over the scale, half to even, then the whole zero point."""
    return F.least(F.greatest(F.rint(x / scale) + zero, F.lit(low)), F.lit(high)).cast("int")


def quantize_float_qparams(x: Column, scale: Column, zero: Column, low: int = 0, high: int = 255) -> Column:
    """With a zero point that need not be whole: the inverse of the scale multiplies, and the zero point is added before the rounding (half to even)."""
    return F.least(F.greatest(F.rint(x * (1 / scale) + zero), F.lit(low)), F.lit(high)).cast("int")


def dequantize_float_qparams(q: Column, scale: Column, zero: Column) -> Column:
    return (q - zero) * scale


def quantize_dynamic(df: DataFrame, value: str, low: int = -128, high: int = 127) -> DataFrame:
    """q, scale and zero from the table's own range: one row, broadcast."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scale, zero = qparams(F.col("_lo"), F.col("_hi"), low, high)
    return df.join(F.broadcast(ends.select(scale.alias("scale"), zero.alias("zero")))).withColumn("q", quantize(F.col(value), F.col("scale"), F.col("zero"), low, high))


def quantize_per_channel(df: DataFrame, params: DataFrame, on: str, value: str, low: int = -128, high: int = 127) -> DataFrame:
    """params: on, scale, zero."""
    return df.join(params, on).withColumn("q", quantize(F.col(value), F.col("scale"), F.col("zero"), low, high))


def made(q: Column, scale: Column, zero: Column) -> Column:
    """A quantised number from its parts: what the whole number stands for."""
    return (q - zero) * scale


def fake_quantize(x: Column, scale: Column, zero: Column, low: int = -128, high: int = 127) -> Column:
    """Struct of value and mask: whether it lay inside the range."""
    q = F.rint(x / scale) + zero
    return F.struct(((F.least(F.greatest(q, F.lit(low)), F.lit(high)) - zero) * scale).alias("v"), q.between(low, high).alias("mask"))


def learnable_backward(x: Column, grad: Column, scale: Column, zero: Column, factor: float = 1.0, low: int = -128, high: int = 127) -> Column:
    """Each number's share of the gradients of x, scale and zero point."""
    q = F.rint(x / scale) + zero
    inside = q.between(low, high)
    edge = F.when(q < low, F.lit(low)).otherwise(F.lit(high))
    dscale = F.when(inside, F.rint(x / scale) - x / scale).otherwise(edge - zero)
    return F.struct(F.when(inside, grad).otherwise(0.0).alias("dx"), (grad * dscale * factor).alias("dscale"), (grad * F.when(inside, 0.0).otherwise(-scale) * factor).alias("dzero"))


def moving_range(stats: DataFrame, running: DataFrame, factor: float) -> DataFrame:
    """An observer's range moved towards a batch's: both one row with lo and hi."""
    r = running.select(F.col("lo").alias("_l"), F.col("hi").alias("_h"))
    move = lambda old, new: (F.col(old) + factor * (F.col(new) - F.col(old))).alias(new)
    return stats.join(F.broadcast(r)).select(move("_l", "lo"), move("_h", "hi"))


def pack_int4(a: Column) -> Column:
    """Pairs of whole numbers from 0 to 15 in one byte's worth each: the even place is the high half."""
    pair = F.sequence(F.lit(0), F.floor(F.size(a) / 2).cast("int") - 1)
    return F.transform(pair, lambda i: (F.get(a, 2 * i) * 16 + F.get(a, 2 * i + 1)).cast("int"))


def unpack_int4(a: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.array(F.floor(x / 16).cast("int"), F.pmod(x, F.lit(16)).cast("int"))))


def int4_mm(x: Column, packed: Column, scale: Column, zero: Column) -> Column:
    """Dot product of an array with one packed weight row."""
    w = unpack_int4(packed)
    return F.aggregate(F.zip_with(x, w, lambda a, q: a * (q - 8) * scale + a * zero), F.lit(0.0), lambda s, v: s + v)


# recurrent cells: gates as columns
def lstm_cell(i: Column, f: Column, g: Column, o: Column, c: Column) -> Column:
    """Struct of h and c from the four gates' sums and the cell before."""
    from ..functions.elementwise import sigmoid

    new = sigmoid(f) * c + sigmoid(i) * F.tanh(g)
    return F.struct((sigmoid(o) * F.tanh(new)).alias("h"), new.alias("c"))


def lstm_cell_backward(i: Column, f: Column, g: Column, o: Column, c: Column, dh: Column, dc: Column) -> Column:
    """Gradients of the gates' sums and of the cell before."""
    from ..functions.elementwise import sigmoid

    i, f, g, o = sigmoid(i), sigmoid(f), F.tanh(g), sigmoid(o)
    t = F.tanh(f * c + i * g)
    d = dc + dh * o * (1 - t * t)
    return F.struct((d * g * i * (1 - i)).alias("di"), (d * c * f * (1 - f)).alias("df"), (d * i * (1 - g * g)).alias("dg"), (dh * t * o * (1 - o)).alias("do"), (d * f).alias("dc"))


def gru_cell(r: list[Column], z: list[Column], n: list[Column], h: Column) -> Column:
    """New h; each gate's input and hidden parts."""
    from ..functions.elementwise import sigmoid

    reset, update = sigmoid(r[0] + r[1]), sigmoid(z[0] + z[1])
    new = F.tanh(n[0] + reset * n[1])
    return (1 - update) * new + update * h


def gru_cell_backward(r: list[Column], z: list[Column], n: list[Column], h: Column, dh: Column) -> Column:
    """Gradients of the gates' sums (of n: input and hidden part) and of h."""
    from ..functions.elementwise import sigmoid

    reset, update = sigmoid(r[0] + r[1]), sigmoid(z[0] + z[1])
    new = F.tanh(n[0] + reset * n[1])
    dn = dh * (1 - update) * (1 - new * new)
    return F.struct((dn * n[1] * reset * (1 - reset)).alias("dr"), (dh * (h - new) * update * (1 - update)).alias("dz"), dn.alias("dn_in"), (dn * reset).alias("dn_hidden"), (dh * update).alias("dh"))


# loss scaling
def unscale(df: DataFrame, value: str, scale: float) -> DataFrame:
    return df.withColumn(value, F.col(value) / scale)


def found_inf(df: DataFrame, value: str) -> DataFrame:
    """One row: 1 if any gradient is infinite or NaN."""
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    return df.agg(F.coalesce(F.max(odd.cast("double")), F.lit(0.0)).alias("found_inf"))


def update_scale(scale: Column, good_steps: Column, found: Column, growth: float = 2.0, backoff: float = 0.5, interval: int = 2000) -> Column:
    """Struct of the next scale and the count of good steps."""
    grows = good_steps + 1 == interval
    new = F.when(found > 0, scale * backoff).when(grows, scale * growth).otherwise(scale)
    return F.struct(new.alias("scale"), F.when((found > 0) | grows, 0).otherwise(good_steps + 1).cast("long").alias("good_steps"))

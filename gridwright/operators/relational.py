"""Tensor operators over tables: explicit key, order and value columns in place of dimensions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elementwise
from . import ordered, selection
from .ordered import match

NAN = float("nan")
REACH = 256.0


# reductions as aggregate expressions
def amax(c): return F.max(c)
def amin(c): return F.when(F.bool_or(F.isnan(c)), NAN).otherwise(F.min(c))
def total(c): return F.coalesce(F.sum(c), F.lit(0))
def mean(c): return F.coalesce(F.avg(c), F.lit(NAN))
def prod(c): return F.coalesce(F.product(c), F.lit(1.0))
def nansum(c): return F.coalesce(F.sum(F.nanvl(c, F.lit(0.0))), F.lit(0.0))
def count_nonzero(c): return F.count_if(c != 0)
def any_(c): return F.coalesce(F.bool_or(c != 0), F.lit(False))
def all_(c): return F.coalesce(F.bool_and(c != 0), F.lit(True))
def argmax(c, at): return F.negative(F.max(F.struct(c.alias("v"), F.negative(at).alias("i")))["i"])
def argmin(c, at): return F.min(F.struct((~F.isnan(c.cast("double"))).alias("n"), c.alias("v"), at.alias("i")))["i"]
def var(c, correction=1):
    n = F.count(c)
    return F.when(n > correction, F.try_divide(F.var_pop(c) * n, n - correction)).otherwise(NAN)
def std(c, correction=1): return F.sqrt(var(c, correction))
def norm(c, p=2.0):
    if p == 0:
        return F.count_if(c != 0).cast("double")
    if math.isinf(p):
        return F.max(F.abs(c)) if p > 0 else F.min(F.abs(c))
    return F.pow(F.sum(F.pow(F.abs(c), F.lit(float(p)))), F.lit(1.0 / p))


def _by(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def kth(df: DataFrame, keys: list[str], value: str, at: str, k: int) -> DataFrame:
    """The k-th smallest value of each group, ties by position."""
    return selection.select(df, keys, value, at, lambda n, nan: F.lit(k))


def median(df: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """The lower median of each group and its position; NaN sorts last and wins if there is any."""
    return selection.select(df, keys, value, at, lambda n, nan: F.when(nan > 0, n - nan + 1).otherwise(F.floor((n + 1) / 2)))


def nanmedian(df: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """The lower median of each group's numbers, NaN left out; of a group of NaN alone its first."""
    return selection.select(df, keys, value, at, lambda n, nan: F.greatest(F.floor((n - nan + 1) / 2), F.lit(1)))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    return counts.groupBy(*keys).agg(F.min(F.struct(F.negative("_c"), F.col(value)))[value].alias("mode"))


#: Spark takes the first rows of a window's group before the shuffle up to this rank.
FEW = 1000


def topk(df: DataFrame, keys: list[str], value: str, at: str, k: int, largest: bool = True) -> DataFrame:
    """The k first rows of each group and their rank. For small k each task keeps its own first k; for more, rows are ranked in parts."""
    if k <= FEW or (largest and selection.order_number(df, value) is None):
        order = F.desc(value) if largest else F.asc(value)
        return df.withColumn("rank", F.row_number().over(_by(keys, order, at))).where(F.col("rank") <= k)
    key = F.bitwise_not(selection.order_number(df, value)) if largest else F.col(value)
    return ordered.numbered(df.withColumn("_o", key), ["_o", at], "rank", keys).withColumn("rank", (F.col("rank") + 1).cast("int")).where(F.col("rank") <= k).drop("_o")


def sort_rank(df: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    return ordered.numbered(df, [value, at], "rank", keys)


def scan(df: DataFrame, keys: list[str], at: str, **values: tuple[str, Column]) -> DataFrame:
    """Running aggregates in the order of `at` within the keys: name=("sum", "product", "max" or "min", column)."""
    return ordered.scan(df, keys, [at], **values)


def cummax(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Running maximum and the latest position that has it."""
    best = F.struct(F.col(value).alias("v"), F.col(at).alias("i"))
    out = ordered.scan(df, keys, [at], _best=("max", best))
    return out.select(*df.columns, F.col("_best.v").alias("cummax"), F.col("_best.i").alias("at"))


def cummin(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    best = F.struct((~F.isnan(F.col(value).cast("double"))).alias("n"), F.col(value).alias("v"), F.negative(at).alias("i"))
    out = ordered.scan(df, keys, [at], _best=("min", best))
    return out.select(*df.columns, F.col("_best.v").alias("cummin"), F.negative(F.col("_best.i")).alias("at"))


def logcumsumexp(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """log of the running sum of exponentials. Rows are taken in epochs in which the running maximum stays within one step of REACH, so no term
    that counts underflows; the epochs' totals, a row each, carry on from one to the next."""
    n = df.count()
    rows = ordered.scan(df, keys, [at], n_rows=n, _top=("max", F.col(value))).withColumn("_e", F.floor(F.col("_top") / REACH).cast("double"))
    shift = (F.col("_e") + 1) * REACH
    term = F.exp(F.col(value) - shift)
    totals = rows.groupBy(*keys, "_e").agg(F.sum(term).alias("_t")).select(*keys, "_e", (elementwise.log(F.col("_t")) + shift).alias("_t"))
    earlier = totals.select(*keys, F.col("_e").alias("_before"), F.col("_t").alias("_bt"))
    pairs = match(totals.select(*keys, "_e"), earlier, keys, "inner").where("_before < _e")
    most = match(pairs, pairs.groupBy(*keys, "_e").agg(F.max("_bt").alias("_most")), [*keys, "_e"])
    carry = most.groupBy(*keys, "_e").agg(
        F.when(F.max("_most") == float("-inf"), float("-inf")).otherwise(F.max("_most") + F.log(F.sum(F.exp(F.col("_bt") - F.col("_most"))))).alias("_carry")
    )
    out = ordered.scan(rows, [*keys, "_e"], [at], n_rows=n, _s=("sum", term)).withColumn("_own", elementwise.log(F.col("_s")) + shift)
    out = match(out, carry, [*keys, "_e"])
    both = F.when(F.col("_carry").isNull(), F.col("_own")).otherwise(elementwise.logaddexp(F.col("_own"), F.col("_carry")))
    return out.withColumn("logcumsumexp", both).select(*df.columns, "logcumsumexp")


def global_scan(df: DataFrame, at: str, **values: Column) -> DataFrame:
    """Running sums over the whole table in the order of `at`."""
    return ordered.scan(df, [], [at], **{n: ("sum", c) for n, c in values.items()})


def global_cumsum(df: DataFrame, at: str, value: str) -> DataFrame:
    return global_scan(df, at, cumsum=F.col(value))


def numbered(df: DataFrame, at: str, name: str = "n") -> DataFrame:
    """Each row's number from 0 in the order of `at`."""
    return ordered.numbered(df, [at], name)


def roll(df: DataFrame, keys: list[str], at: str, value: str, shift: int) -> DataFrame:
    """rolled: the value `shift` places before, in the order of `at`, around the ends of the group."""
    rows = by_key(ordered.numbered(df, [at], "_i", keys), keys, [F.count("*").alias("_n")])
    moved = rows.select(*keys, F.pmod(F.col("_i") + shift, F.col("_n")).alias("_i"), F.col(value).alias("rolled"))
    return match(rows, moved, [*keys, "_i"]).select(*df.columns, "rolled")


def unfold(df: DataFrame, keys: list[str], at: str, value: str, size: int, step: int) -> DataFrame:
    """Each window of `size` values, every `step` rows in the order of `at`: the columns of its first row, window (array), window_no. A row goes to the
    windows that it is in, so a group is no single task's."""
    rows = ordered.numbered(df, [at], "_i", keys)
    last = F.call_function("div", F.col("_i"), F.lit(step))
    first = F.greatest(F.ceil((F.col("_i") - size + 1) / step), F.lit(0))
    placed = rows.withColumn("window_no", F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))))
    held = placed.groupBy(*keys, "window_no").agg(F.sort_array(F.collect_list(F.struct("_i", F.col(value).alias("v")))).alias("_w"), F.min_by(F.struct(*df.columns), "_i").alias("_row"))
    return held.where(F.size("_w") == size).select("_row.*", F.transform("_w", lambda x: x["v"]).alias("window"), "window_no")


def unique_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("counts"))


def unique_inverse(df: DataFrame, value: str) -> DataFrame:
    """Each row's place among the sorted distinct values, null the first of them; the distinct values alone are ranked."""
    return match(df, numbered(df.select(value).distinct(), value, "inverse"), [value])


def unique_consecutive(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Runs of equal values in the order of `at`; nulls that follow each other are a run."""
    n = df.count()
    rows = ordered.previous(df, keys, [at], value)
    fresh = F.col("_previous").isNull() | ~F.col("_previous.v").eqNullSafe(F.col(value))
    runs = ordered.scan(rows, keys, [at], n_rows=n, run=("sum", fresh.cast("long")))
    return runs.groupBy(*keys, "run").agg(F.min(value).alias(value), F.count("*").alias("counts"), F.min(at).alias("start"))


def bincount(df: DataFrame, value: str, weight: str | None = None, minlength: int = 0) -> DataFrame:
    """Count, or sum of weights, of every whole number from 0 to the largest."""
    top = df.agg(F.max(value)).first()[0]
    every = df.sparkSession.range(max(-1 if top is None else int(top), minlength - 1) + 1).withColumnRenamed("id", value)
    found = df.groupBy(F.col(value).cast("long").alias(value)).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return every.join(found, value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def histc(df: DataFrame, value: str, bins: int, low: float = 0.0, high: float = 0.0) -> DataFrame:
    """Equal bins over [low, high], the last one closed; rows outside are not counted, bins without a row are 0. Where low is high the data's range
    is taken, and one more on both sides of a single value."""
    if low == high:
        low, high = (float(x or 0) for x in df.agg(F.min(value), F.max(value)).first())
    if low == high:
        low, high = low - 1, high + 1
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high))
    place = F.least(F.floor((F.col(value) - low) * bins / (high - low)), F.lit(bins - 1)).cast("long")
    found = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, columns: dict[str, list[float]], weight: str | None = None) -> DataFrame:
    """Counts, or sums of weights, of cells given by each column's edges; the last cell of a column is closed, rows outside don't count."""
    rows = df
    for c, edges in columns.items():
        x = F.col(c)
        at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)) - 1  # noqa: B023
        at = F.when(x == float(edges[-1]), F.lit(len(edges) - 2)).otherwise(at)
        rows = rows.withColumn(f"_{c}", at.cast("long")).where(F.col(f"_{c}").between(0, len(edges) - 2))
    grid = df.sparkSession.range(1).drop("id")
    for c, edges in columns.items():
        grid = grid.withColumn(f"_{c}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(edges) - 2).cast("long"))))
    names = [f"_{c}" for c in columns]
    found = rows.groupBy(*names).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return grid.join(found, names, "left").select(*[F.col(f"_{c}").alias(c) for c in columns], F.coalesce("n", F.lit(0)).alias("n"))


def histogram_of_bins(df: DataFrame, bins: dict[str, int], spans: dict[str, tuple[float, float]] | None = None, weight: str | None = None) -> DataFrame:
    """As histogram, for a number of equal bins a column over a range; without one, over the data's own, which is one more on both sides of a single
    value. Counts and extremes alone reach the driver."""
    spans = dict(spans or {})
    free = [c for c in bins if c not in spans]
    if free:
        ends = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(free) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        for i, c in enumerate(free):
            low, high = float(ends[f"lo{i}"] or 0), float(ends[f"hi{i}"] or 0)
            spans[c] = (low - 1, high + 1) if low == high else (low, high)
    rows = df
    for c, n in bins.items():
        low, high = spans[c]
        at = F.least(F.floor((F.col(c) - low) / ((high - low) / n)), F.lit(n - 1)).cast("long")
        rows = rows.withColumn(f"_{c}", F.when(F.col(c).between(low, high), at)).where(F.col(f"_{c}").isNotNull())
    found = rows.groupBy(*[F.col(f"_{c}").alias(f"_{c}") for c in bins]).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    grid = df.sparkSession.range(math.prod(bins.values()))
    step = math.prod(bins.values())
    for c, n in bins.items():
        step //= n
        grid = grid.withColumn(f"_{c}", F.pmod(F.floor(F.col("id") / step), F.lit(n)).cast("long"))
    return grid.join(found, [f"_{c}" for c in bins], "left").select(*[F.col(f"_{c}").alias(c) for c in bins], F.coalesce("n", F.lit(0)).alias("n"))


def bucketize(value: Column, bounds: list[float], right: bool = False) -> Column:
    """How many bounds are below the value (right: not above it); NaN goes after all."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= value if right else b < value)).cast("long")


def searchsorted(bounds: DataFrame, queries: DataFrame, value: str, right: bool = False) -> DataFrame:
    """Place of each query among the bounds, from counts of the distinct values; they alone are ranked. A null query has a null place; null bounds
    don't count."""
    asked = queries.select(F.col(value).alias("_v"), F.struct("*").alias("_q"))
    counts = bounds.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    steps = asked.select("_v").distinct().join(counts, "_v", "full").select("_v", F.coalesce("_n", F.lit(0)).alias("_n"))
    ranked = global_scan(steps.where(F.col("_v").isNotNull()), "_v", _upto=F.col("_n"))
    place = F.col("_upto") if right else F.col("_upto") - F.col("_n")
    return asked.join(ranked, "_v", "left").select("_q.*", place.alias("place"))


# gather and scatter
def gather(source: DataFrame, index: DataFrame, on: str) -> DataFrame:
    return index.join(source, on)


def scatter_reduce(target: DataFrame, source: DataFrame, on: str, value: str, how: str, include_self: bool = True, into: str = "v", whole: bool = False) -> DataFrame:
    """target[into] combined with the source's values of the same index; indices without a source keep theirs. whole: means of whole numbers are
    rounded down."""
    agg = {"sum": F.sum, "prod": F.product, "mean": F.sum, "amax": F.max, "amin": lambda c: amin(F.col(c))}[how]
    got = source.groupBy(on).agg(agg(value).alias("_s"), F.count(value).alias("_n"))
    joined = target.join(got, on, "left")
    own, new = F.col(into), F.col("_s")
    share = lambda total, n: F.floor(total / n) if whole else total / n
    if include_self:
        least = F.when(F.isnan(own.cast("double")) | F.isnan(new.cast("double")), NAN).otherwise(F.least(own, new)) if how == "amin" and not whole else F.least(own, new)
        both = {"sum": own + new, "prod": own * new, "mean": share(own + new, F.col("_n") + 1), "amax": F.greatest(own, new), "amin": least}[how]
    else:
        both = share(new, F.col("_n")) if how == "mean" else new
    return joined.withColumn(into, F.when(new.isNull(), own).otherwise(both)).drop("_s", "_n")


def embedding_bag(bags: DataFrame, weight: DataFrame, on: str, bag: str, value: str, how: str) -> DataFrame:
    agg = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    return bags.join(weight, on).groupBy(bag).agg(agg(value).alias("v"))


def repeat_interleave(df: DataFrame, times: str) -> DataFrame:
    return df.where(F.col(times) > 0).select("*", F.explode(F.sequence(F.lit(0), F.col(times) - 1)).alias("copy"))


# softmax and normalisation over groups
def by_key(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """df with aggregates of its groups: summed in two steps and joined back. A key may hold any share of the rows: where the groups are few their
    table is broadcast (Spark checks its size), else the join is dealt anew where it is skewed. Rows of a null key are a group."""
    return match(df, df.groupBy(*keys).agg(*aggs), keys, "inner")


def softmax(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    top = by_key(df, keys, [F.max(value).alias("_m")]).withColumn("_d", F.col(value) - F.col("_m"))
    out = by_key(top, keys, [F.sum(F.exp("_d")).alias("_s")])
    return out.withColumn("softmax", F.exp("_d") / F.col("_s")).withColumn("log_softmax", F.col("_d") - F.log("_s")).select(*df.columns, "softmax", "log_softmax")


def layer_norm(df: DataFrame, keys: list[str], value: str, eps: float = 1e-5) -> DataFrame:
    out = by_key(df, keys, [F.avg(value).alias("_m"), F.var_pop(value).alias("_v")])
    return out.withColumn("normed", (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + eps)).select(*df.columns, "normed")


def batch_norm_stats(df: DataFrame, keys: list[str], value: str, eps: float = 1e-5) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (1 / F.sqrt(F.var_pop(value) + eps)).alias("invstd"))


# array columns
def dot(a, b): return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
def distance(a, b, p=2.0):
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y))
    if math.isinf(p):
        return F.array_max(gaps)
    if p == 0:
        return F.size(F.filter(gaps, lambda g: g != 0)).cast("double")
    return F.pow(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + F.pow(g, F.lit(float(p)))), F.lit(1.0 / p))


#: Pairs of rows that a block of an all-pairs result makes, about.
PAIRS = 1 << 22


def block_count(left: DataFrame, right: DataFrame) -> int:
    """Blocks into which the right side is dealt where each row of the left meets each of its rows: as many as the result needs."""
    return max(1, -(-left.count() * right.count() // PAIRS))


def cdist(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Each row of `queries`, a stated query set, beside each point: the result has that many rows. Points are dealt into blocks, as many as the result's
    size asks for, and each query goes to every block, so no side is held whole by a task, and both are shuffled by block."""
    blocks = block_count(queries, points)
    dealt = points.withColumn("_block", F.pmod(F.xxhash64(*points.columns), F.lit(blocks)))
    asked = queries.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return asked.join(dealt, "_block").drop("_block")


# matrices in coordinate form: i, j, v
def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def coalesce(m: DataFrame) -> DataFrame:
    return m.groupBy("i", "j").agg(F.sum("v").alias("v"))


def row_pointers(m: DataFrame, rows: int) -> DataFrame:
    """The CSR pointer of each row, and of the end: how many stored values lie in smaller rows."""
    n = m.groupBy("i").agg(F.count("*").alias("n"))
    every = m.sparkSession.range(rows + 1).withColumnRenamed("id", "i").join(n, "i", "left")
    return global_cumsum(every.select("i", F.coalesce("n", F.lit(0)).alias("n")), "i", "n").select("i", (F.col("cumsum") - F.col("n")).alias("ptr"))


# quantisation
def quantize(x: Column, scale: float, zero: int, low: int = -128, high: int = 127) -> Column:
    return F.least(F.greatest(F.rint(x / scale) + zero, F.lit(low)), F.lit(high)).cast("int")


def dequantize(q: Column, scale: float, zero: int) -> Column:
    return (q - zero) * F.lit(scale)


def fake_quantize(x: Column, scale: float, zero: int, low: int = -128, high: int = 127) -> Column:
    return dequantize(quantize(x, scale, zero, low, high), scale, zero)


# losses, for each row; aggregate with avg or sum
def mse(a, b): return (a - b) * (a - b)
def smooth_l1(a, b, beta=1.0): return F.when(F.abs(a - b) < beta, 0.5 * (a - b) * (a - b) / beta).otherwise(F.abs(a - b) - 0.5 * beta)
def huber(a, b, delta=1.0): return F.when(F.abs(a - b) <= delta, 0.5 * (a - b) * (a - b)).otherwise(delta * (F.abs(a - b) - 0.5 * delta))
def bce(p, y):
    bound = lambda c: F.greatest(F.coalesce(c, F.lit(-100.0)), F.lit(-100.0))
    return -(y * bound(F.log(p)) + (1 - y) * bound(F.log1p(-p)))
def bce_with_logits(x, y): return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))

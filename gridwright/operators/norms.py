"""Normalisation over tables: statistics are one aggregate in two steps, joined back by key; gradients are two sums a group, joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elementwise as e
from .relational import by_key

INF = float("inf")


def safe_softmax(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Softmax that is 0, not NaN, in a group of minus infinities alone."""
    top = by_key(df, keys, [F.max(value).alias("_m")]).withColumn("_e", F.when(F.col("_m") == -INF, 0.0).otherwise(F.exp(F.col(value) - F.col("_m"))))
    out = by_key(top, keys, [F.sum("_e").alias("_s")])
    return out.withColumn("softmax", e.div(F.col("_e"), F.when(F.col("_m") == -INF, 1.0).otherwise(F.col("_s")))).select(*df.columns, "softmax")


def masked_softmax(df: DataFrame, keys: list[str], value: str, mask: str) -> DataFrame:
    """Rows with a true mask are left out and get 0."""
    hidden = df.withColumn("_v", F.when(F.col(mask), F.lit(-INF)).otherwise(F.col(value)))
    return safe_softmax(hidden, keys, "_v").drop("_v")


def softmax_backward(df: DataFrame, keys: list[str], grad: str, out: str, log: bool = False) -> DataFrame:
    """v: the input's gradient from the gradient and the forward result."""
    g, y = F.col(grad), F.col(out)
    rows = by_key(df, keys, [F.sum(g if log else g * y).alias("_s")])
    return rows.withColumn("v", g - F.exp(y) * F.col("_s") if log else y * (g - F.col("_s"))).drop("_s")


def normalised(df: DataFrame, keys: list[str], value: str, eps: float = 1e-5, weight: Column | None = None, bias: Column | None = None) -> DataFrame:
    """Layer and group norm: v, and each group's mean and rstd. weight and bias: columns of the row, or none."""
    out = by_key(df, keys, [F.avg(value).alias("mean"), (1 / F.sqrt(F.var_pop(value) + eps)).alias("rstd")])
    v = (F.col(value) - F.col("mean")) * F.col("rstd")
    v = v if weight is None else v * weight
    return out.withColumn("normed", v if bias is None else v + bias)


def normalised_backward(df: DataFrame, keys: list[str], value: str, grad: str, eps: float = 1e-5, weight: Column | None = None) -> DataFrame:
    """The input's gradient of layer, group and batch norm: the gradient less its mean and its projection on the normalised values."""
    rows = normalised(df, keys, value, eps).withColumn("_g", F.col(grad) * (weight if weight is not None else 1.0))
    rows = by_key(rows, keys, [F.avg("_g").alias("_mg"), F.avg(F.col("_g") * F.col("normed")).alias("_mp")])
    return rows.withColumn("v", F.col("rstd") * (F.col("_g") - F.col("_mg") - F.col("normed") * F.col("_mp"))).select(*df.columns, "v")


def weight_gradients(df: DataFrame, on: str, grad: str, normed: str) -> DataFrame:
    """dweight and dbias of each channel."""
    return df.groupBy(on).agg(F.sum(F.col(grad) * F.col(normed)).alias("dweight"), F.sum(grad).alias("dbias"))


def rms_norm(df: DataFrame, keys: list[str], value: str, eps: float = 1e-6, weight: Column | None = None) -> DataFrame:
    out = by_key(df, keys, [(1 / F.sqrt(F.avg(F.col(value) * F.col(value)) + eps)).alias("rrms")])
    v = F.col(value) * F.col("rrms")
    return out.withColumn("normed", v if weight is None else v * weight)


def rms_norm_backward(df: DataFrame, keys: list[str], value: str, grad: str, eps: float = 1e-6, weight: Column | None = None) -> DataFrame:
    rows = rms_norm(df, keys, value, eps).withColumn("_g", F.col(grad) * (weight if weight is not None else 1.0))
    rows = by_key(rows, keys, [F.avg(F.col("_g") * F.col("normed")).alias("_mp")])
    return rows.withColumn("v", F.col("rrms") * (F.col("_g") - F.col("normed") * F.col("_mp"))).select(*df.columns, "v")


# batch norm in its parts: a channel's statistics are a row
def update_stats(stats: DataFrame, running: DataFrame, on: str, momentum: float) -> DataFrame:
    """stats: on, mean, var (unbiased); running: on, mean, var. Both move by the momentum."""
    r = running.select(on, F.col("mean").alias("_rm"), F.col("var").alias("_rv"))
    moved = lambda old, new: ((1 - momentum) * F.col(old) + momentum * F.col(new)).alias(new)
    return stats.join(r, on).select(on, moved("_rm", "mean"), moved("_rv", "var"))


def channel_stats(df: DataFrame, on: str, value: str) -> DataFrame:
    return df.groupBy(on).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def gather_stats(parts: DataFrame, on: str, eps: float = 1e-5) -> DataFrame:
    """One mean and invstd of each channel from those of several parts (on, mean, invstd, n). Parts' means are taken from the least of them, and their
    variances grow by the squares of what is left from the common mean, so large means lose no digits."""
    low = by_key(parts, [on], [F.min("mean").alias("_low")]).withColumn("_off", F.col("mean") - F.col("_low"))
    rows = by_key(low, [on], [(F.sum(F.col("_off") * F.col("n")) / F.sum("n")).alias("_mid")])
    off = F.col("_off") - F.col("_mid")
    var = F.sum((1 / (F.col("invstd") * F.col("invstd")) - eps + off * off) * F.col("n")) / F.sum("n")
    return rows.groupBy(on).agg((F.min("_low") + F.min("_mid")).alias("mean"), (1 / F.sqrt(var + eps)).alias("invstd"))


def _affine(df: DataFrame, affine: DataFrame | None, on: str) -> DataFrame:
    """df with _weight and _bias of its channel; 1 and 0 without a table (on, weight, bias)."""
    if affine is None:
        return df.withColumns({"_weight": F.lit(1.0), "_bias": F.lit(0.0)})
    return df.join(affine.select(on, F.col("weight").alias("_weight"), F.col("bias").alias("_bias")), on)


def elemt(df: DataFrame, stats: DataFrame, on: str, value: str, affine: DataFrame | None = None) -> DataFrame:
    """Values normalised by given statistics (on, mean, invstd), then scaled and shifted by their channel's weight and bias (affine: on, weight, bias)."""
    rows = _affine(df.join(stats, on), affine, on)
    v = (F.col(value) - F.col("mean")) * F.col("invstd") * F.col("_weight") + F.col("_bias")
    return rows.withColumn("normed", v).drop("mean", "invstd", "_weight", "_bias")


def backward_reduce(df: DataFrame, stats: DataFrame, on: str, value: str, grad: str) -> DataFrame:
    """sum_dy, sum_dy_xmu, dweight and dbias of each channel."""
    rows = df.join(stats, on)
    xmu = F.sum(F.col(grad) * (F.col(value) - F.col("mean")))
    return rows.groupBy(on).agg(F.sum(grad).alias("sum_dy"), xmu.alias("sum_dy_xmu"), (xmu * F.first("invstd")).alias("dweight"), F.sum(grad).alias("dbias"))


def backward_elemt(df: DataFrame, stats: DataFrame, sums: DataFrame, on: str, value: str, grad: str, n: int, affine: DataFrame | None = None) -> DataFrame:
    """The input's gradient from the channels' sums over all n values of a channel (affine: on, weight, bias)."""
    rows = _affine(df.join(stats, on).join(sums.select(on, "sum_dy", "sum_dy_xmu"), on), affine, on)
    x = (F.col(value) - F.col("mean")) * F.col("invstd") * F.col("invstd") * F.col("sum_dy_xmu") / n
    return rows.withColumn("v", (F.col(grad) - F.col("sum_dy") / n - x) * F.col("invstd") * F.col("_weight")).select(*df.columns, "v")


def weight_norm(df: DataFrame, on: str, value: str, size: str) -> DataFrame:
    """Each row vector scaled to the length `size`; also its norm."""
    out = by_key(df, [on], [F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm")])
    return out.withColumn("w", F.col(value) * F.col(size) / F.col("norm"))


def weight_norm_backward(df: DataFrame, on: str, value: str, size: str, grad: str) -> DataFrame:
    """Gradients of the vector (dv) and of its length (dg)."""
    rows = by_key(weight_norm(df, on, value, size), [on], [F.sum(F.col(grad) * F.col(value)).alias("_p")])
    dv = F.col(size) / F.col("norm") * (F.col(grad) - F.col(value) * F.col("_p") / (F.col("norm") * F.col("norm")))
    return rows.withColumn("dv", dv).withColumn("dg", F.col("_p") / F.col("norm")).drop("_p", "w", "norm")


def renorm(df: DataFrame, keys: list[str], value: str, p: float, most: float) -> DataFrame:
    """Groups whose p-norm is over `most` are scaled down to it. Embedding rows that are looked up are renormed so."""
    from .relational import norm

    out = by_key(df, keys, [norm(F.col(value), p).alias("_n")])
    return out.withColumn(value, F.when(F.col("_n") > most, F.col(value) * most / (F.col("_n") + 1e-7)).otherwise(F.col(value))).drop("_n")


# losses of classes
def nll(df: DataFrame, keys: list[str], target: str, weights: dict[int, float] | None = None, ignore: int = -100) -> DataFrame:
    """df: keys, class, v (log probabilities), target. loss and weight of each item: minus its target's log probability, weighted."""
    w = _class_weight(F.col(target), weights)
    rows = df.where((F.col("class") == F.col(target)) & (F.col(target) != ignore))
    return rows.select(*keys, (-F.col("v") * w).alias("loss"), w.alias("weight"))


def _class_weight(c: Column, weights: dict[int, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.element_at(F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]), c.cast("int"))


def nll_backward(df: DataFrame, target: str, grad: str, weights: dict[int, float] | None = None, ignore: int = -100) -> DataFrame:
    hit = (F.col("class") == F.col(target)) & (F.col(target) != ignore)
    return df.withColumn("v", F.when(hit, -F.col(grad) * _class_weight(F.col(target), weights)).otherwise(0.0))


def multi_margin(df: DataFrame, keys: list[str], target: str, classes: int, p: int = 1, margin: float = 1.0) -> DataFrame:
    """Hinge of every other class's score against the target's, over the number of classes."""
    own = F.max(F.when(F.col("class") == F.col(target), F.col("v"))).alias("_o")
    gap = F.greatest(margin - F.col("_o") + F.col("v"), F.lit(0.0))
    rows = by_key(df, keys, [own]).where(F.col("class") != F.col(target))
    return rows.groupBy(*keys).agg((F.sum(gap if p == 1 else gap * gap) / classes).alias("loss"))


def multi_margin_backward(df: DataFrame, keys: list[str], target: str, grad: str, classes: int, p: int = 1, margin: float = 1.0) -> DataFrame:
    own = F.max(F.when(F.col("class") == F.col(target), F.col("v"))).alias("_o")
    rows = by_key(df, keys, [own])
    gap = margin - F.col("_o") + F.col("v")
    slope = F.when((gap > 0) & (F.col("class") != F.col(target)), F.lit(1.0) if p == 1 else 2 * gap).otherwise(0.0) * F.col(grad) / classes
    rows = by_key(rows.withColumn("_d", slope), keys, [F.sum("_d").alias("_t")])
    return rows.withColumn("dv", F.when(F.col("class") == F.col(target), -F.col("_t")).otherwise(F.col("_d"))).drop("_o", "_d", "_t")


def multilabel_margin(df: DataFrame, keys: list[str], is_target: str, classes: int) -> DataFrame:
    """Hinge of every class that is no target against every one that is, over the number of classes. Within an item: targets times classes."""
    rows = df.select(*keys, "class", "v", F.col(is_target).alias("_t"))
    yes, no = rows.where("_t").select(*keys, F.col("v").alias("_y")), rows.where("not _t").select(*keys, F.col("v").alias("_n"))
    gap = F.greatest(1 - F.col("_y") + F.col("_n"), F.lit(0.0))
    got = yes.join(no, keys).groupBy(*keys).agg((F.sum(gap) / classes).alias("loss"))
    return rows.select(*keys).distinct().join(got, keys, "left").withColumn("loss", F.coalesce("loss", F.lit(0.0)))


def multilabel_margin_backward(df: DataFrame, keys: list[str], is_target: str, grad: str, classes: int) -> DataFrame:
    rows = df.select(*keys, "class", "v", F.col(is_target).alias("_t"), F.col(grad).alias("_g"))
    yes = rows.where("_t").select(*keys, F.col("class").alias("_cy"), F.col("v").alias("_y"), "_g")
    no = rows.where("not _t").select(*keys, F.col("class").alias("_cn"), F.col("v").alias("_n"))
    pairs = yes.join(no, keys).where(1 - F.col("_y") + F.col("_n") > 0)
    ends = pairs.select(*keys, F.inline(F.array(F.struct(F.col("_cy").alias("class"), (-F.col("_g") / classes).alias("_d")), F.struct(F.col("_cn").alias("class"), (F.col("_g") / classes).alias("_d")))))
    total = ends.groupBy(*keys, "class").agg(F.sum("_d").alias("dv"))
    return df.join(total, [*keys, "class"], "left").withColumn("dv", F.coalesce("dv", F.lit(0.0)))


def ctc(logs: Column, labels: Column, blank: int = 0) -> Column:
    """Minus the log likelihood of a label sequence: the forward recursion over an item's frames, all in one row.

    logs: array (a frame each) of arrays (a class each) of log probabilities; labels: array of classes, without blanks."""
    none = F.lit(-1e300)
    places = F.concat(F.flatten(F.transform(labels, lambda x: F.array(F.lit(blank), x.cast("int")))), F.array(F.lit(blank)))  # blanks between and around
    at = lambda a, i: F.coalesce(F.get(a, i), none)
    add = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    first = F.transform(places, lambda c, i: F.when(i < 2, F.get(F.get(logs, F.lit(0)), c)).otherwise(none))

    def step(alpha: Column, frame: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            two = add(at(alpha, i), F.when(i >= 1, at(alpha, i - 1)).otherwise(none))
            skip = F.when((i >= 2) & (c != blank) & (c != F.get(places, i - 2)), at(alpha, i - 2)).otherwise(none)
            return add(two, skip) + F.get(frame, c)

        return F.transform(places, one)

    last = F.aggregate(F.slice(logs, 2, F.greatest(F.size(logs) - 1, F.lit(0))), first, step)
    n = F.size(places)
    return -add(F.get(last, n - 1), F.when(n > 1, at(last, n - 2)).otherwise(none))


def ctc_backward(logs: Column, labels: Column, blank: int = 0) -> Column:
    """Gradient of ctc in the log probabilities: an array (a frame each) of arrays (a class each). The share of a class is that of the paths through it:
    forward sums, and backward sums as forward ones of the reversed frames and labels."""
    none = F.lit(-1e300)
    places = F.concat(F.flatten(F.transform(labels, lambda x: F.array(F.lit(blank), x.cast("int")))), F.array(F.lit(blank)))
    at = lambda a, i: F.coalesce(F.get(a, i), none)
    add = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))

    def sums(frames: Column, path: Column) -> Column:
        first = F.transform(path, lambda c, i: F.when(i < 2, F.get(F.get(frames, F.lit(0)), c)).otherwise(none))

        def step(done: Column, frame: Column) -> Column:
            alpha = F.element_at(done, -1)

            def one(c: Column, i: Column) -> Column:
                two = add(at(alpha, i), F.when(i >= 1, at(alpha, i - 1)).otherwise(none))
                skip = F.when((i >= 2) & (c != blank) & (c != F.get(path, i - 2)), at(alpha, i - 2)).otherwise(none)
                return add(two, skip) + F.get(frame, c)

            return F.concat(done, F.array(F.transform(path, one)))

        return F.aggregate(F.slice(frames, 2, F.greatest(F.size(frames) - 1, F.lit(0))), F.array(first), step)

    forward, back = sums(logs, places), F.reverse(F.transform(sums(F.reverse(logs), F.reverse(places)), lambda r: F.reverse(r)))
    loss = ctc(logs, labels, blank)

    def frame(lp: Column, t: Column) -> Column:
        through = F.zip_with(F.get(forward, t), F.get(back, t), lambda a, b: a + b)  # the frame's own probability is in both
        share = lambda k: F.aggregate(F.zip_with(through, places, lambda w, c: F.when(c == k, F.exp(w - F.get(lp, c) + loss)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
        return F.transform(lp, lambda x, k: -share(k))

    return F.transform(logs, frame)

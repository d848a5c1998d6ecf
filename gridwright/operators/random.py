"""Random columns by inverse distribution functions of uniform numbers. A seed gives the same numbers for the same partitions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special
from .factor import let


def _u(seed: int) -> Column:
    """Above 0 and at most 1."""
    return 1 - F.rand(seed)


def uniform(low=0.0, high=1.0, seed=0): return F.rand(seed) * (high - low) + low
def random_integer(low: int, high: int, seed=0): return F.floor(F.rand(seed) * (high - low) + low).cast("long")
def normal(mean=0.0, std=1.0, seed=0): return F.randn(seed) * std + mean
def bernoulli(p, seed=0): return (F.rand(seed) < p).cast("double")
def log_normal(mean=0.0, std=1.0, seed=0): return F.exp(normal(mean, std, seed))
def exponential(rate=1.0, seed=0): return -F.log(_u(seed)) / rate
def geometric(p, seed=0): return F.greatest(F.ceil(F.log(_u(seed)) / math.log(1 - p)), F.lit(1)).cast("double")
def cauchy(median=0.0, sigma=1.0, seed=0): return median + sigma * F.tan(math.pi * (F.rand(seed) - 0.5))


def dropout(x: Column, p: float, seed=0) -> Column:
    """Struct of value and mask: kept numbers grow by 1 / (1 - p)."""
    kept = F.rand(seed) < 1 - p
    return F.struct(F.when(kept, x / (1 - p)).otherwise(0.0).alias("v"), kept.alias("mask"))


# tries of a rejection: the chance that none of them is accepted is below 1e-20
TRIES = 40
#: Below this expectation a draw is found by adding up probabilities, which end within STEPS.
SMALL, STEPS = 10.0, 120


def _stream(seed: int, **more: Column) -> Column:
    """What a row's uniform numbers are hashed from, and values that go with it."""
    return F.struct(F.rand(seed).alias("a"), F.rand(seed + 1).alias("b"), *[c.cast("double").alias(n) for n, c in more.items()])


def _uniform(s: Column, k: Column, j: int) -> Column:
    """The j-th uniform number of try k, above 0 and below 1."""
    return (F.pmod(F.xxhash64(s["a"], s["b"], k, F.lit(j)), F.lit(1 << 48)) + 0.5) / float(1 << 48)


def log_factorial(k: Column) -> Column:
    """From a table up to 15, then by the asymptotic series (error below 1e-11)."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = F.greatest(k, F.lit(16.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(k < 16, F.get(table, F.greatest(k, F.lit(0.0)).cast("int"))).otherwise(series)


def _added_up(s: Column, first: Column, ratio) -> Column:
    """The least k whose distribution function reaches a uniform number. ratio(k): the probability of k over that of k - 1."""
    start = F.struct(_uniform(s, F.lit(0), 0).alias("u"), first.alias("p"), first.alias("sum"), F.lit(0).alias("k"))

    def step(t: Column, k: Column) -> Column:
        p = t["p"] * ratio(k)
        return F.when(t["u"] <= t["sum"], t).otherwise(F.struct(t["u"].alias("u"), p.alias("p"), (t["sum"] + p).alias("sum"), k.alias("k")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["k"].cast("double")


def _accepted(s: Column, one) -> Column:
    """The first number that a try gives; one(k) is null where a try is rejected."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), lambda got, k: F.when(got.isNotNull(), got).otherwise(one(k)))


def poisson(rate: Column, seed=0) -> Column:
    """Poisson numbers of any rate: by adding up below 10, else by transformed rejection, whose tries are accepted nine times in ten whatever the rate."""

    def draw(s: Column) -> Column:
        r = s["rate"]
        b = 0.931 + 2.53 * F.sqrt(r)
        a = -0.059 + 0.02483 * b

        def one(k: Column) -> Column:
            u, v = _uniform(s, k, 1) - 0.5, _uniform(s, k, 2)
            edge = 0.5 - F.abs(u)
            n = F.floor((2 * a / edge + b) * u + r + 0.43).cast("double")
            inner = (edge >= 0.07) & (v <= 0.9277 - 3.6224 / (b - 2))
            bound = F.log(v) + F.log(1.1239 + 1.1328 / (b - 3.4)) - F.log(a / (edge * edge) + b) <= -r + n * F.log(r) - log_factorial(n)
            return F.when(inner | ((n >= 0) & ~((edge < 0.013) & (v > edge)) & bound), n)

        return F.when(r <= 0, 0.0).when(r < SMALL, _added_up(s, F.exp(-r), lambda k: r / k)).otherwise(_accepted(s, one))

    return let(_stream(seed, rate=rate), draw)


def binomial(n: int | Column, p: Column, seed=0) -> Column:
    """Successes of n trials, in a number of steps that doesn't grow with n: as Poisson numbers, for the rarer of both outcomes."""

    def draw(s: Column) -> Column:
        n, p = s["n"], F.least(s["p"], 1 - s["p"])
        q, odds = 1 - p, p / (1 - p)
        spread = F.sqrt(n * p * q)
        b = 1.15 + 2.53 * spread
        a = -0.0873 + 0.0248 * b + 0.01 * p
        mode = F.floor((n + 1) * p).cast("double")

        def one(k: Column) -> Column:
            u, v = _uniform(s, k, 1) - 0.5, _uniform(s, k, 2)
            edge = 0.5 - F.abs(u)
            x = F.floor((2 * a / edge + b) * u + n * p + 0.5).cast("double")
            inner = (edge >= 0.07) & (v <= 0.92 - 4.2 / b)
            height = F.log(v * (2.83 + 5.1 / b) * spread / (a / (edge * edge) + b))
            bound = height <= log_factorial(mode) + log_factorial(n - mode) - log_factorial(x) - log_factorial(n - x) + (x - mode) * F.log(odds)
            return F.when((x >= 0) & (x <= n) & (inner | bound), x)

        few = _added_up(s, F.exp(n * F.log1p(-p)), lambda k: F.greatest(n - k + 1, F.lit(0.0)) / k * odds)
        got = F.when((p <= 0) | (n <= 0), 0.0).when(n * p < SMALL, few).otherwise(_accepted(s, one))
        return F.when(s["p"] <= 0.5, got).otherwise(n - got)

    return let(_stream(seed, n=F.lit(n) if isinstance(n, int) else n, p=p), draw)


def standard_gamma(shape: Column, seed=0, rounds: int = 24) -> Column:
    """Squeeze of a cubed normal number, the first of `rounds` tries that is accepted (each is with over 95 %); shapes below 1 by a power of a
    uniform number. The row's stream is held once: a copy of it in a test and one in its result would part after the first try that fails."""

    def draw(s: Column) -> Column:
        shape = s["shape"]
        d = F.when(shape < 1, shape + 1).otherwise(shape) - 1 / 3
        c = 1 / F.sqrt(9 * d)

        def tried(k: Column) -> Column:
            x = F.sqrt(-2 * F.log(_uniform(s, k, 1))) * F.cos(2 * math.pi * _uniform(s, k, 2))
            v = F.pow(1 + c * x, F.lit(3.0))
            fine = (v > 0) & (F.log(_uniform(s, k, 3)) < 0.5 * x * x + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300))))
            return F.when(fine, d * v)

        found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(None).cast("double"), lambda got, k: F.coalesce(got, tried(k)))
        lift = F.when(shape < 1, F.pow(_uniform(s, F.lit(0), 4), 1 / shape)).otherwise(1.0)
        return F.coalesce(found, d) * lift

    return let(_stream(seed, shape=shape), draw)


def dirichlet(df: DataFrame, keys: list[str], shape: str, seed=0) -> DataFrame:
    """v: gamma numbers over their group's sum."""
    from .relational import by_key

    rows = df.withColumn("v", standard_gamma(F.col(shape), seed))
    return by_key(rows, keys, [F.sum("v").alias("_s")]).withColumn("v", F.col("v") / F.col("_s")).drop("_s")


def standard_gamma_grad(shape: Column, x: Column, step: float = 1e-4) -> Column:
    """Slope of a gamma number in its shape at a fixed probability: minus the distribution function's slope in the shape over its density."""
    slope = (special.igamma(shape + step, x) - special.igamma(shape - step, x)) / (2 * step)
    density = F.exp((shape - 1) * F.log(x) - x - special.lgamma(shape))
    return -slope / density


def multinomial(df: DataFrame, keys: list[str], weight: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group without replacement, by weight: the k largest of log(u) / weight, taken in two steps so that a large group is not
    sorted by one task."""
    from pyspark.sql import Window

    rows = df.where(F.col(weight) > 0).withColumn("_k", F.log(_u(seed)) / F.col(weight)).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    for by in ([*keys, "_salt"], keys):  # a row that isn't among its part's best isn't among its group's
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_k")))).where(F.col("_n") <= k)
    return rows.drop("_k", "_n", "_salt")


def dirichlet_grad(x: Column, shape: Column, total: Column) -> Column:
    """Slope of a Dirichlet number in its own shape at a fixed probability of its beta distribution (shape, total - shape), by differences."""
    step = 1e-4
    slope = (_beta_below(x, shape + step, total - shape) - _beta_below(x, shape - step, total - shape)) / (2 * step)
    log = special.lgamma(total) - special.lgamma(shape) - special.lgamma(total - shape)
    return -slope / F.exp(log + (shape - 1) * F.log(x) + (total - shape - 1) * F.log1p(-x))


#: Places of the trapezoid rule, and how far apart they are.
PLACES, WIDTH = 241, 0.05


@F.pandas_udf(T.DoubleType())
def _beta_integral(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """The beta density up to x without its factor, after a substitution that makes the integrand die out at both ends; each place for all rows."""
    x, a, b = (c.to_numpy(float) for c in (x, a, b))
    sums = np.zeros(len(x))
    with np.errstate(all="ignore"):
        for k in range(-(PLACES // 2), PLACES // 2 + 1):  # u = x / (1 + exp(-pi sinh s))
            e = math.exp(-math.pi * math.sinh(k * WIDTH))
            u = x / (1 + e)
            term = np.exp((a - 1) * np.log(u) + (b - 1) * np.log1p(-u)) * u * (e / (1 + e) * math.pi * math.cosh(k * WIDTH))
            sums += np.where(np.isnan(term), 0.0, term)
    return pd.Series(sums * WIDTH)


def _beta_below(x: Column, a: Column, b: Column) -> Column:
    """Distribution function of a beta number by the trapezoid rule."""
    return _beta_integral(x.cast("double"), a.cast("double"), b.cast("double")) * F.exp(special.lgamma(a + b) - special.lgamma(a) - special.lgamma(b))

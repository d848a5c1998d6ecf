import math

from pyspark.sql import functions as F

from gridwright.functions import elementwise as e
from gridwright.functions import special as s


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_ieee_cases(spark):
    nan, inf = float("nan"), float("inf")
    lit = F.lit
    cases = [
        (e.div(lit(1.0), lit(0.0)), inf), (e.div(lit(-1.0), lit(0.0)), -inf), (e.div(lit(0.0), lit(0.0)), nan), (e.fmod(lit(5.0), lit(0.0)), nan),
        (e.remainder(lit(7.0), lit(-3.0)), -2.0), (e.fmod(lit(-7.0), lit(3.0)), -1.0), (e.floor_divide(lit(1.0), lit(0.1)), 9.0), (e.floor(lit(1e300)), 1e300),
        (e.log(lit(0.0)), -inf), (e.log(lit(-1.0)), nan), (e.minimum(lit(nan), lit(1.0)), nan), (e.fmin(lit(nan), lit(1.0)), 1.0), (e.clamp(lit(nan), 0, 1), nan),
        (e.heaviside(lit(nan), lit(0.5)), 0.0), (e.sign(lit(nan)), 0.0), (e.round_(lit(-2.5)), -2.0), (e.eq(lit(nan), lit(nan)), False), (e.gt(lit(nan), lit(1.0)), False),
        (e.copysign(lit(2.0), lit(-0.0)), -2.0), (e.gcd(lit(-12), lit(18)), 6), (e.lcm(lit(4), lit(6)), 12), (e.trunc(lit(-1.7)), -1.0), (e.chebyshev_t(lit(0.3), 5), math.cos(5 * math.acos(0.3))),
        (e.hermite_h(lit(2.0), 3), 40.0), (e.legendre_p(lit(0.5), 2), -0.125), (e.laguerre_l(lit(1.0), 2), -0.5), (e.relu(lit(nan)), nan),
        (s.erf(lit(0.5)), math.erf(0.5)), (s.erfinv(lit(0.5)), 0.4769362762044699), (s.digamma(lit(1.0)), -0.5772156649015329), (s.i0(lit(1.0)), 1.2660658777520084),
        (s.bessel_j0(lit(1.0)), 0.7651976865579666), (s.bessel_j1(lit(1.0)), 0.4400505857449335), (s.lgamma(lit(-1.0)), inf),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (_, want) in enumerate(cases):
        got = row[i]
        assert (math.isnan(got) and math.isnan(want)) or got == want or abs(got - want) < 1e-9, (i, got, want)


def test_special_values_equal_numpy(spark):
    """Every pair of odd numbers through the elementwise operators, against numpy, whose rules are IEEE's."""
    import numpy as np

    odd = [0.0, -0.0, 1.0, -1.0, 2.5, -2.5, 0.5, math.inf, -math.inf, math.nan, 1e308, -1e-308]
    pairs = [(float(a), float(b)) for a in odd for b in odd]
    rows = spark.createDataFrame(pairs, "a double, b double")
    a, b = F.col("a"), F.col("b")
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    with np.errstate(all="ignore"):
        cases = {
            "add": (e.add(a, b), x + y), "sub": (e.sub(a, b), x - y), "mul": (e.mul(a, b), x * y), "div": (e.div(a, b), np.where(y == 0, np.where((x == 0) | np.isnan(x), np.nan, np.sign(x) * np.inf), x / np.where(y == 0, 1, y))),
            "maximum": (e.maximum(a, b), np.maximum(x, y)), "minimum": (e.minimum(a, b), np.minimum(x, y)), "fmax": (e.fmax(a, b), np.fmax(x, y)), "fmin": (e.fmin(a, b), np.fmin(x, y)), "fmod": (e.fmod(a, b), np.fmod(x, y)),
            "hypot": (e.hypot(a, b), np.hypot(x, y)), "atan2": (e.atan2(a, b), np.arctan2(x, y)), "logaddexp": (e.logaddexp(a, b), np.logaddexp(x, y)), "copysign": (e.copysign(a, b), np.copysign(x, np.where(np.isnan(y), 1, y))),
            "sqrt": (e.sqrt(a), np.sqrt(x)), "log": (e.log(a), np.log(x)), "log1p": (e.log1p(a), np.log1p(x)), "log2": (e.log2(a), np.log2(x)), "log10": (e.log10(a), np.log10(x)), "exp": (e.exp(a), np.exp(x)), "expm1": (e.expm1(a), np.expm1(x)),
            "floor": (e.floor(a), np.floor(x)), "ceil": (e.ceil(a), np.ceil(x)), "trunc": (e.trunc(a), np.trunc(x)), "round": (e.round_(a), np.rint(x)), "abs": (e.abs_(a), np.abs(x)), "neg": (e.neg(a), -x), "tanh": (e.tanh(a), np.tanh(x)),
            "asin": (e.asin(a), np.arcsin(x)), "acosh": (e.acosh(a), np.arccosh(x)), "atanh": (e.atanh(a), np.arctanh(x)), "sin": (e.sin(a), np.sin(x)), "eq": (e.eq(a, b), x == y), "ne": (e.ne(a, b), x != y), "lt": (e.lt(a, b), x < y), "ge": (e.ge(a, b), x >= y),
            "isinf": (e.isinf(a), np.isinf(x)), "signbit": (e.signbit(a), np.signbit(np.where(np.isnan(x), 1, x))), "nan_to_num": (e.nan_to_num(a), np.nan_to_num(x)), "heaviside": (e.heaviside(a, b), np.where(np.isnan(x) | (x < 0), 0, np.where(x > 0, 1, y))),
            "relu": (e.relu(a), np.where(np.isnan(x), np.nan, np.maximum(x, 0))), "sigmoid": (e.sigmoid(a), 1 / (1 + np.exp(-x))), "frexp": (e.frexp(a)["mantissa"], np.where(np.abs(x) == 1e-308, np.frexp(x)[0], np.frexp(x)[0])), "erf": (s.erf(a), [math.erf(v) for v in x]),
        }
    got = rows.select(*[c.cast("double").alias(n) for n, (c, _) in cases.items()]).toPandas()
    for n, (_, want) in cases.items():
        want = np.asarray(want, float)
        assert np.allclose(got[n].to_numpy(float), want, rtol=1e-12, atol=0, equal_nan=True), (n, [(p, g, w) for p, g, w in zip(pairs, got[n], want, strict=True) if not (g == w or g != g and w != w)][:5])


def test_nulls_stay_null(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(e.add(none, F.lit(1.0)).alias("a"), e.exp(none).alias("b"), s.erf(none).alias("c"), e.maximum(none, none).alias("d")).first()
    assert tuple(row) == (None,) * 4


def test_scans_and_histograms_at_the_edges(spark):
    from gridwright.operators import relational as r

    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([-1000.0, 0.0, -2000.0, 1000.0, 999.0])] + [(1, 0, -math.inf), (1, 1, 3.0)], "k int, i int, v double")
    got = {(x.k, x.i): x.logcumsumexp for x in r.logcumsumexp(df, ["k"], "i", "v").collect()}
    assert [got[0, i] for i in range(4)] == [-1000.0, 0.0, 0.0, 1000.0] and math.isclose(got[0, 4], 1000 + math.log1p(math.exp(-1))) and got[1, 0] == -math.inf and got[1, 1] == 3.0
    soft = {x.i: x.log_softmax for x in r.softmax(df.where("k = 0 and i < 4"), ["k"], "v").collect()}
    assert soft[3] == 0 and soft[0] == -2000
    assert [x.n for x in r.histc(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4).orderBy("bin").collect()] == [0, 0, 2, 0]
    least = r.scatter_reduce(spark.createDataFrame([(0, 5.0)], "i int, v double"), spark.createDataFrame([(0, math.nan), (0, 7.0)], "i int, s double"), "i", "s", "amin").first()
    assert math.isnan(least.v)
    table = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "v string")
    assert {(x.v, x.inverse) for x in r.unique_inverse(table, "v").collect()} == {("a", 0), ("b", 1), ("c", 2)}

"""Operators over lists of columns: three columns of numbers between 0 and 1 of every customer, one query for each operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import elementwise as e
from ..functions import special
from ..operators import relational as r

PRIMES = {"a": 97, "b": 89, "c": 83}
#: operator: (Column function, SQL of V; W is the second list's value of the same column)
UNARY = {
    "abs": (lambda v: e.abs_(e.neg(v)), "V"), "acos": (e.acos, "acos(V)"), "asin": (e.asin, "asin(V)"), "atan": (e.atan, "atan(V)"), "ceil": (e.ceil, "ceil(V)"), "cos": (e.cos, "cos(V)"), "cosh": (e.cosh, "(exp(V) + exp(-V)) / 2"),
    "exp": (e.exp, "exp(V)"), "expm1": (e.expm1, "exp(V) - 1"), "floor": (e.floor, "floor(V)"), "frac": (e.frac, "V - trunc(V)"), "log": (e.log, "ln(V)"), "log10": (e.log10, "log10(V)"), "log1p": (e.log1p, "ln(1 + V)"), "log2": (e.log2, "log2(V)"),
    "neg": (e.neg, "-V"), "reciprocal": (e.reciprocal, "1 / V"), "round": (lambda v: e.round_(v * 10), "round_even(V * 10, 0)"), "sigmoid": (e.sigmoid, "1 / (1 + exp(-V))"), "sign": (e.sign, "sign(V)"), "sin": (e.sin, "sin(V)"), "sinh": (e.sinh, "(exp(V) - exp(-V)) / 2"),
    "sqrt": (e.sqrt, "sqrt(V)"), "tan": (e.tan, "tan(V)"), "tanh": (e.tanh, "1 - 2 / (exp(2 * V) + 1)"), "trunc": (lambda v: e.trunc(v * 10), "trunc(V * 10)"), "rsqrt": (e.rsqrt, "1 / sqrt(V)"), "zero": (lambda v: F.lit(0.0), "0"), "copy": (lambda v: v, "V"),
    "lgamma": (special.lgamma, "lgamma(V)"), "erf": (special.erf, "2 / sqrt(pi()) * list_sum(list_transform(range(0, 40), lambda k: (-1) ** k * V ** (2 * k + 1) / (gamma(k + 1) * (2 * k + 1))))"),
    "erfc": (special.erfc, "1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 40), lambda k: (-1) ** k * V ** (2 * k + 1) / (gamma(k + 1) * (2 * k + 1))))"),
}
BINARY = {
    "add": (lambda v, w: e.add(v, w, 2), "V + 2 * W"), "sub": (e.sub, "V - W"), "mul": (e.mul, "V * W"), "div": (e.div, "V / W"), "maximum": (e.maximum, "greatest(V, W)"), "minimum": (e.minimum, "least(V, W)"), "pow": (e.pow_, "pow(V, W)"),
    "clamp_min": (lambda v, w: e.clamp(v, lo=w), "greatest(V, W)"), "clamp_max": (lambda v, w: e.clamp(v, hi=w), "least(V, W)"), "lerp": (lambda v, w: e.lerp(v, w, 0.25), "V + 0.25 * (W - V)"),
    "addcmul": (lambda v, w: e.addcmul(v, w, v, 3), "V + 3 * W * V"), "addcdiv": (lambda v, w: e.addcdiv(v, w, v, 3), "V + 3 * (W / V)"),
}


def _lists():
    k = F.col("c_custkey")
    first = [(k % p + 1) / F.lit(float(p + 2)) for p in PRIMES.values()]
    return first, [((k + 11) % p + 1) / F.lit(float(p + 2)) for p in PRIMES.values()]


def _sql(text: str, p: int) -> str:
    v, w = f"((c_custkey % {p} + 1) / {p + 2}.0::DOUBLE)", f"(((c_custkey + 11) % {p} + 1) / {p + 2}.0::DOUBLE)"
    return text.replace("V", v).replace("W", w)


def _query(f, two: bool):
    def run(spark, sf_dir):
        first, second = _lists()
        out = e.foreach(f, first, second) if two else e.foreach(f, first)
        return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", *[(F.round(c.cast("double"), 6) + 0.0).alias(n) for c, n in zip(out, PRIMES, strict=True)])

    return run


def _reduced(f):
    def run(spark, sf_dir):
        first, _ = _lists()
        return spark.read.parquet(f"{sf_dir}/customer.parquet").agg(*[F.round(c, 6).alias(n) for c, n in zip(e.foreach(f, first), PRIMES, strict=True)])

    return run


def build() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for table, two in ((UNARY, False), (BINARY, True)):
        for name, (f, text) in table.items():
            queries[f"foreach_{name}"] = _query(f, two)
            columns = ", ".join(f"round(CAST({_sql(text, p)} AS DOUBLE), 6) + 0.0 AS {n}" for n, p in PRIMES.items())
            sql[f"foreach_{name}"] = f"SELECT c_custkey, {columns} FROM customer"
    for name, f, text in (("norm", r.norm, "sqrt(sum(V * V))"), ("max", r.amax, "max(V)")):
        queries[f"foreach_{name}"] = _reduced(f)
        sql[f"foreach_{name}"] = "SELECT " + ", ".join(f"round({_sql(text, p)}, 6) AS {n}" for n, p in PRIMES.items()) + " FROM customer"
    return queries, sql

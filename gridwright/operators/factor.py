"""Factors of small matrices that are a value of a row: Cholesky, LDL, Householder QR, Jacobi eigenvalues and singular values, exponentials.

A matrix is array<array<double>>, its rows; reflections hold columns. All are array expressions, so a batch of matrices is a projection that Catalyst
plans with what is around it. A column that a later expression reads inside its lambdas should be made by `held`.

A singular or indefinite matrix gives NaN in the places that it leaves undefined, never an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linalg import lu, lu_solve, solve_triangular

NAN = float("nan")
MATRIX, VECTOR = "array<array<double>>", "array<double>"


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, computed once a row: the optimiser doesn't copy a generator's columns into the lambdas that read them, which would
    compute them at every place. Columns of the same names are replaced."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def upto(n: Column | int) -> Column:
    """0 .. n - 1; nothing for 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.sequence(F.lit(0), n), 1, n)


def at(m: Column, i, j) -> Column:
    return F.get(F.get(m, i), j)


def over(a: Column, b: Column) -> Column:
    return F.when(b == 0, NAN).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def dot(a: Column, b: Column) -> Column:
    """Sum of the products over the places that both have."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def transpose(m: Column) -> Column:
    return F.transform(upto(F.size(F.get(m, 0))), lambda j: F.transform(m, lambda r: F.get(r, j)))


def product(a: Column, b: Column) -> Column:
    return let(transpose(b), lambda c: F.transform(a, lambda r: F.transform(c, lambda x: dot(r, x))))


def apply(m: Column, x: Column) -> Column:
    return F.transform(m, lambda r: dot(r, x))


def identity(n: Column) -> Column:
    return F.transform(upto(n), lambda i: F.transform(upto(n), lambda j: (i == j).cast("double")))


def trace(m: Column) -> Column:
    return F.aggregate(F.transform(m, lambda r, i: F.get(r, i)), F.lit(0.0), lambda s, x: s + x)


def _mix(a: Column, b: Column, f: Column, g: Column) -> Column:
    """f a + g b of two vectors."""
    return F.zip_with(a, b, lambda x, y: f * x + g * y)


def _rows(n: Column, make: Callable[[Column, Column], Column]) -> Column:
    """Rows made one after another from those before."""
    return F.aggregate(upto(n), F.array().cast(MATRIX), lambda done, i: F.concat(done, F.array(make(done, i))))


def _padded(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(0.0), F.size(rows) - F.size(r))))


# definite and symmetric matrices
def cholesky(m: Column) -> Column:
    """Lower L with L L^T = m, row by row from the lower triangle of m."""

    def row(done: Column, i: Column) -> Column:
        def cell(r: Column, j: Column) -> Column:
            own = F.get(done, j)
            return F.when(j == i, F.sqrt(at(m, i, i) - dot(r, r))).otherwise(over(at(m, i, j) - dot(own, r), F.get(own, j)))

        return F.aggregate(upto(i + 1), F.array().cast(VECTOR), lambda r, j: F.concat(r, F.array(cell(r, j))))

    return let(_rows(F.size(m), row), _padded)


def cholesky_info(l: Column) -> Column:  # noqa: E741
    """0, or the size of the first leading block that isn't positive definite."""
    odd = F.transform(l, lambda r, i: F.when(F.isnan(F.get(r, i)) | (F.get(r, i) <= 0), i + 1))
    return F.coalesce(F.get(F.filter(odd, lambda x: x.isNotNull()), 0), F.lit(0))


def cholesky_solve(l: Column, b: Column) -> Column:  # noqa: E741
    return let(transpose(l), lambda u: solve_triangular(u, solve_triangular(l, b, False), True))


def cholesky_inverse(l: Column) -> Column:  # noqa: E741
    return F.transform(identity(F.size(l)), lambda e: cholesky_solve(l, e))


def ldl(m: Column) -> Column:
    """L below the diagonal (its own is one) and D on it, without interchanges: m must have leading blocks that aren't singular."""

    def row(done: Column, i: Column) -> Column:
        scaled = F.aggregate(upto(i), F.array().cast(VECTOR), lambda w, j: F.concat(w, F.array(at(m, i, j) - dot(F.get(done, j), w))))

        def close(w: Column) -> Column:
            own = F.transform(w, lambda x, j: over(x, at(done, j, j)))
            return let(own, lambda o: F.concat(o, F.array(at(m, i, i) - dot(w, o))))

        return let(scaled, close)

    return let(_rows(F.size(m), row), _padded)


def ldl_solve(ld: Column, b: Column) -> Column:
    middle = lambda y: F.transform(y, lambda x, i: over(x, at(ld, i, i)))
    return let(middle(solve_triangular(ld, b, False, True)), lambda y: let(transpose(ld), lambda u: solve_triangular(u, y, True, True)))


# orthogonal factors by reflections
def geqrf(m: Column) -> Column:
    """Struct of columns (R on and above the diagonal, reflectors below, their first place 1 left out) and tau."""
    start = F.struct(transpose(m).alias("columns"), F.array().cast(VECTOR).alias("tau"))

    def step(s: Column, k: Column) -> Column:
        x = F.get(s["columns"], k)
        rest = F.aggregate(F.filter(x, lambda _, i: i > k), F.lit(0.0), lambda t, v: t + v * v)

        def reflect(h: Column) -> Column:
            head, beta = F.get(x, k), h["beta"]
            tau = F.when(h["rest"] == 0, 0.0).otherwise(over(beta - head, beta))
            v = F.transform(x, lambda c, i: F.when(i < k, 0.0).when(i == k, 1.0).otherwise(F.when(h["rest"] == 0, 0.0).otherwise(over(c, head - beta))))

            def update(r: Column) -> Column:
                put = lambda c, j: F.when(
                    j == k, F.transform(c, lambda y, i: F.when(i == k, beta).when(i > k, F.get(r["v"], i)).otherwise(y))
                ).when(j > k, _mix(c, r["v"], F.lit(1.0), -r["tau"] * dot(c, r["v"]))).otherwise(c)
                return F.struct(F.transform(s["columns"], put).alias("columns"), F.concat(s["tau"], F.array(r["tau"])).alias("tau"))

            return let(F.struct(v.alias("v"), tau.alias("tau")), update)

        head = F.get(x, k)
        size = F.sqrt(head * head + rest)
        return let(F.struct(rest.alias("rest"), F.when(rest == 0, head).when(head < 0, size).otherwise(-size).alias("beta")), reflect)

    return F.aggregate(upto(F.least(F.size(m), F.size(F.get(m, 0)))), start, step)


def _reflector(columns: Column, k: Column) -> Column:
    return F.transform(F.get(columns, k), lambda x, i: F.when(i < k, 0.0).when(i == k, 1.0).otherwise(x))


def ormqr(factors: Column, columns: Column, transposed: bool = False) -> Column:
    """Q (or its transpose) times a matrix of columns, by the reflectors one after another."""
    order = upto(F.size(factors["tau"]))

    def turn(held: Column, k: Column) -> Column:
        tau = F.get(factors["tau"], k)
        return let(_reflector(factors["columns"], k), lambda v: F.transform(held, lambda c: _mix(c, v, F.lit(1.0), -tau * dot(c, v))))

    return F.aggregate(order if transposed else F.reverse(order), columns, turn)


def householder_product(factors: Column) -> Column:
    """The first columns of Q, as many as the reflectors."""
    rows = F.size(F.get(factors["columns"], 0))
    unit = F.transform(upto(F.size(factors["tau"])), lambda j: F.transform(upto(rows), lambda i: (i == j).cast("double")))
    return ormqr(factors, unit)


def r_rows(factors: Column) -> Column:
    """R by rows."""
    return F.transform(upto(F.size(factors["tau"])), lambda i: F.transform(factors["columns"], lambda c, j: F.when(j >= i, F.get(c, i)).otherwise(0.0)))


def lstsq(factors: Column, b: Column) -> Column:
    """x with the least squares of m x - b, for m of full rank and as many rows as columns or more, from its factors."""
    return solve_triangular(r_rows(factors), F.get(ormqr(factors, F.array(b), True), 0), True)


def lu_unpack(factors: Column) -> Column:
    """Struct of p, l and u with p l u = m, from the struct of lu."""
    n = F.size(factors["lu"])
    p = F.transform(upto(n), lambda i: F.transform(factors["perm"], lambda r: (r == i).cast("double")))
    lower = F.transform(factors["lu"], lambda r, i: F.transform(r, lambda x, j: F.when(j < i, x).when(j == i, 1.0).otherwise(0.0)))
    upper = F.transform(factors["lu"], lambda r, i: F.transform(r, lambda x, j: F.when(j >= i, x).otherwise(0.0)))
    return F.struct(p.alias("p"), lower.alias("l"), upper.alias("u"))


# eigenvalues
def _pairs(n: Column, sweeps: int) -> Column:
    """All p < q, `sweeps` times over."""
    each = F.flatten(F.transform(upto(n), lambda q: F.transform(upto(q), lambda p: F.struct(p.alias("p"), q.alias("q")))))
    return F.flatten(F.array_repeat(each, sweeps))


def _rotation(diagonal: Column, off: Column) -> Column:
    """Struct of c and s of the rotation that clears `off`; diagonal: the later less the earlier place."""
    ratio = over(diagonal, 2 * off)
    t = F.when(off == 0, 0.0).otherwise(F.when(ratio < 0, -1.0).otherwise(1.0) / (F.abs(ratio) + F.sqrt(ratio * ratio + 1)))
    return let(t, lambda t: let(1 / F.sqrt(t * t + 1), lambda c: F.struct(c.alias("c"), (t * c).alias("s"))))


def _turned(parts: Column, pq: Column, r: Column) -> Column:
    """Vectors p and q of an array turned by a rotation."""
    a, b = F.get(parts, pq["p"]), F.get(parts, pq["q"])
    return F.transform(parts, lambda x, i: F.when(i == pq["p"], _mix(a, b, r["c"], -r["s"])).when(i == pq["q"], _mix(a, b, r["s"], r["c"])).otherwise(x))


def eigh(m: Column, sweeps: int = 10) -> Column:
    """Struct of values (ascending) and vectors (one for each value, of length 1, its largest place positive) of a symmetric matrix, by cyclic Jacobi
    rotations. Vectors of equal values are any that are orthogonal."""
    start = F.struct(m.alias("a"), identity(F.size(m)).alias("v"))

    def step(s: Column, pq: Column) -> Column:
        a = s["a"]
        turn = _rotation(at(a, pq["q"], pq["q"]) - at(a, pq["p"], pq["p"]), at(a, pq["p"], pq["q"]))
        both = lambda r: F.struct(transpose(_turned(transpose(_turned(a, pq, r)), pq, r)).alias("a"), _turned(s["v"], pq, r).alias("v"))
        off = at(a, pq["p"], pq["q"])
        spent = [at(a, pq[k], pq[k]) + off == at(a, pq[k], pq[k]) for k in "pq"]  # too small to change either value
        return F.when((off == 0) | (spent[0] & spent[1]), s).otherwise(let(turn, both))

    def ordered(s: Column) -> Column:
        each = F.sort_array(F.transform(s["a"], lambda r, i: F.struct(F.get(r, i).alias("x"), F.get(s["v"], i).alias("v"))))
        return let(each, lambda e: F.struct(F.transform(e, lambda z: z["x"]).alias("values"), F.transform(e, lambda z: _positive(z["v"])).alias("vectors")))

    return let(F.aggregate(_pairs(F.size(m), sweeps), start, step), ordered)


def _positive(v: Column) -> Column:
    largest = F.array_max(F.transform(v, lambda x: F.struct(F.round(F.abs(x), 9).alias("a"), (x > 0).alias("p"))))
    return F.transform(v, lambda x: F.when(largest["p"], x).otherwise(-x))


def svd(m: Column, sweeps: int = 10) -> Column:
    """Struct of values (descending), u and v (a vector for each value) with m = sum of value * u v^T, by rotations of m's columns until they are
    orthogonal. u is zero where the value is."""
    columns = transpose(m)
    start = F.struct(columns.alias("u"), identity(F.size(F.get(m, 0))).alias("v"))

    def step(s: Column, pq: Column) -> Column:
        a, b = F.get(s["u"], pq["p"]), F.get(s["u"], pq["q"])
        turn = lambda off: F.when(off == 0, s).otherwise(
            let(_rotation(dot(b, b) - dot(a, a), off), lambda r: F.struct(_turned(s["u"], pq, r).alias("u"), _turned(s["v"], pq, r).alias("v")))
        )
        return let(dot(a, b), turn)

    def ordered(s: Column) -> Column:
        each = F.sort_array(F.transform(s["u"], lambda c, i: F.struct(F.sqrt(dot(c, c)).alias("x"), c.alias("u"), F.get(s["v"], i).alias("v"))), asc=False)
        unit = lambda z: F.transform(z["u"], lambda x: F.when(z["x"] == 0, 0.0).otherwise(over(x, z["x"])))
        return let(each, lambda e: F.struct(F.transform(e, lambda z: z["x"]).alias("values"), F.transform(e, unit).alias("u"), F.transform(e, lambda z: z["v"]).alias("v")))

    return let(F.aggregate(_pairs(F.size(F.get(m, 0)), sweeps), start, step), ordered)


def matrix_exp(df: DataFrame, m: str, name: str, degree: int = 8) -> DataFrame:
    """df with the exponential of a matrix: scaling, a diagonal rational approximation (numerator and denominator of this degree), and squaring."""
    size = F.array_max(F.transform(m, lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + F.abs(x))))
    halvings = F.when(size > 0.5, F.ceil(F.log2(F.when(size > 0.5, size).otherwise(1.0))) + 1).otherwise(0).cast("int")
    weights = [math.factorial(2 * degree - k) * math.factorial(degree) / (math.factorial(2 * degree) * math.factorial(k) * math.factorial(degree - k)) for k in range(degree, -1, -1)]

    def series(sign: int) -> Column:
        a = F.col("_small")
        zero = F.transform(a, lambda r: F.transform(r, lambda x: F.lit(0.0)))
        step = lambda acc, w: F.transform(product(acc, a), lambda r, i: F.transform(r, lambda x, j: sign * x + F.when(i == j, w).otherwise(0.0)))
        return F.aggregate(F.array(*[F.lit(w) for w in weights]), zero, step)

    rows = held(df, _h=halvings)
    rows = held(rows, _small=F.transform(m, lambda r: F.transform(r, lambda x: x / F.pow(F.lit(2.0), F.col("_h")))))
    rows = held(rows, _over=series(1), _under=series(-1))
    rows = held(held(rows, _over=transpose(F.col("_over"))), _lu=lu(F.col("_under")))
    rows = held(held(rows, _ratio=F.transform("_over", lambda b: lu_solve(F.col("_lu"), b))), _ratio=transpose(F.col("_ratio")))
    return rows.select(*df.columns, F.aggregate(upto(F.col("_h")), F.col("_ratio"), lambda x, _: product(x, x)).alias(name))


# complex numbers: structs re, im
def _c(re, im) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def _times(a: Column, b: Column) -> Column:
    return _c(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def _divided(a: Column, b: Column) -> Column:
    size = b["re"] * b["re"] + b["im"] * b["im"]
    return let(F.when(size == 0, 1e-300).otherwise(size), lambda n: _c((a["re"] * b["re"] + a["im"] * b["im"]) / n, (a["im"] * b["re"] - a["re"] * b["im"]) / n))


def characteristic(m: Column) -> Column:
    """Struct of c, the coefficients of det(x I - m) from the highest (1) down, and adjugate, the matrices whose sum by powers of x is adj(x I - m)."""
    n = F.size(m)
    first = F.struct(F.array(F.lit(1.0)).alias("c"), F.array().cast(f"array<{MATRIX}>").alias("adjugate"), identity(n).alias("b"))

    def step(s: Column, k: Column) -> Column:
        def close(mb: Column) -> Column:
            return let(-trace(mb) / (k + 1), lambda c: F.struct(
                F.concat(s["c"], F.array(c)).alias("c"), F.concat(s["adjugate"], F.array(s["b"])).alias("adjugate"),
                F.transform(mb, lambda r, i: F.transform(r, lambda x, j: x + F.when(i == j, c).otherwise(0.0))).alias("b"),
            ))

        return let(product(m, s["b"]), close)

    return F.aggregate(upto(n), first, step, lambda s: F.struct(s["c"].alias("c"), s["adjugate"].alias("adjugate")))


def roots(c: Column, rounds: int = 80) -> Column:
    """All complex roots of a polynomial (coefficients from the highest, which is 1), corrected together; sorted by real, then imaginary part."""
    n = F.size(c) - 1
    radius = 1 + F.array_max(F.transform(c, lambda x: F.abs(x)))
    angle = lambda k: 2 * math.pi * k / n + 0.4
    start = F.transform(upto(n), lambda k: _c(radius * F.cos(angle(k)) * 0.7, radius * F.sin(angle(k)) * 0.7))
    value = lambda z: F.aggregate(c, _c(F.lit(0.0), F.lit(0.0)), lambda s, x: let(_times(s, z), lambda t: _c(t["re"] + x, t["im"])))

    def corrected(zs: Column, _: Column) -> Column:
        def one(z: Column, i: Column) -> Column:
            others = F.filter(F.transform(zs, lambda y, j: F.when(j != i, _c(z["re"] - y["re"], z["im"] - y["im"]))), lambda d: d.isNotNull())
            apart = F.aggregate(others, _c(F.lit(1.0), F.lit(0.0)), lambda s, d: _times(s, d))
            return let(_divided(value(z), apart), lambda d: _c(z["re"] - d["re"], z["im"] - d["im"]))

        return F.transform(zs, one)

    found = F.aggregate(upto(rounds), start, corrected)
    near = F.transform(found, lambda z: F.struct(F.round(z["re"], 7).alias("a"), F.round(z["im"], 7).alias("b"), z.alias("z")))
    return F.transform(F.sort_array(near), lambda s: s["z"])


def eigvals(m: Column) -> Column:
    """Eigenvalues of a general matrix, as roots of its characteristic polynomial: for small matrices (up to 8 rows or so); of a value of multiplicity k
    a k-th part of the digits holds."""
    return let(characteristic(m), lambda p: roots(p["c"]))


def eig(m: Column) -> Column:
    """Structs of value and vector (complex, length 1): the longest column of adj(value I - m). A value whose adjugate is zero has no vector here."""
    zero = _c(F.lit(0.0), F.lit(0.0))

    def vector(p: Column, z: Column) -> Column:
        n = F.size(m)
        cell = lambda i, j: F.aggregate(p["adjugate"], zero, lambda s, b: let(_times(s, z), lambda t: _c(t["re"] + at(b, i, j), t["im"])))
        columns = F.transform(upto(n), lambda j: F.transform(upto(n), lambda i: cell(i, j)))
        length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x["re"] * x["re"] + x["im"] * x["im"]))
        best = F.array_max(F.transform(columns, lambda v: F.struct(length(v).alias("n"), v.alias("v"))))
        return let(best, lambda b: F.when(b["n"] > 0, F.transform(b["v"], lambda x: _c(x["re"] / b["n"], x["im"] / b["n"]))))

    return let(characteristic(m), lambda p: F.transform(roots(p["c"]), lambda z: F.struct(z.alias("value"), vector(p, z).alias("vector"))))

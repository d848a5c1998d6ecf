"""Special functions without a built-in form, as Arrow UDFs over whole numpy arrays: quadratures, series and recurrences of a fixed number of terms.

An integral over a smooth function is taken by the trapezoid rule, which converges geometrically for periodic integrands and for those that die out
doubly exponentially, or by Gauss-Legendre points. No function calls Python for a row.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF, NAN = np.inf, np.nan


def _vector(f):
    """f, over float arrays of equal length, as a column function. Nulls stay null."""

    def wide(*columns: pa.Array) -> pa.Array:
        x = [np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False), float) for c in columns]
        with np.errstate(all="ignore"):
            out = f(*x)
        null = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in columns], axis=0)
        return pa.array(np.asarray(out, float), mask=null)

    def one(x: pa.Array) -> pa.Array:
        return wide(x)

    def two(x: pa.Array, y: pa.Array) -> pa.Array:
        return wide(x, y)

    run = F.arrow_udf(two if f.__code__.co_argcount == 2 else one, T.DoubleType())
    return lambda *columns: run(*[c.cast("double") if hasattr(c, "cast") else F.lit(float(c)) for c in columns])


@lru_cache
def _gauss(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def _over(terms, x: np.ndarray, nodes: np.ndarray, weights: np.ndarray, run: int = 4096) -> np.ndarray:
    """Sum of weights times terms(x, node), some thousand values of x at a time."""
    out = np.empty(len(x))
    for a in range(0, len(x), run):
        out[a : a + run] = terms(x[a : a + run, None], nodes[None, :]) @ weights
    return out


def _choose(x, *cases):
    """The value of the first condition that holds: (condition, values) pairs, the last one for the rest."""
    return np.select([c for c, _ in cases[:-1]], [v for _, v in cases[:-1]], cases[-1][1])


# error function
def _erf_small(x):
    t, w = _gauss(40)
    return 2 / math.sqrt(math.pi) * x * _over(lambda x, t: np.exp(-((x * (t + 1) / 2) ** 2)), x, t, w / 2)


def _erfcx_large(x):
    """exp(x**2) erfc(x) for x >= 1, by the trapezoid rule over the integral of exp(-t**2) / (t**2 + x**2) with the pole's own term."""
    h = 0.4
    k = np.arange(1, 17) * h
    total = 1 / (x * x) + 2 * _over(lambda x, t: np.exp(-t * t) / (t * t + x * x), x, k, np.ones(len(k)))
    pole = np.where(x < 6, 2 * np.exp(np.minimum(x, 6) ** 2) / np.expm1(2 * math.pi * np.minimum(x, 6) / h), 0.0)
    return np.where(np.isinf(x), 0.0, x * h / math.pi * total - pole)


def _erfc(x):
    small = np.abs(x) < 1
    far = np.exp(-np.minimum(x * x, 800)) * _erfcx_large(np.maximum(np.abs(x), 1))
    return _choose(x, (np.isnan(x), NAN), (small, 1 - _erf_small(np.where(small, x, 0))), (x > 0, far), (True, 2 - far))


def _erf(x):
    small = np.abs(x) < 1
    return _choose(x, (np.isnan(x), NAN), (small, _erf_small(np.where(small, x, 0))), (True, np.sign(x) * (1 - _erfc(np.abs(x)))))


def _erfcx(x):
    y = np.where(x < 1, 1, x)
    return _choose(x, (np.isnan(x), NAN), (x >= 1, _erfcx_large(y)), (x < -27, INF), (True, np.exp(np.minimum(x * x, 800)) * _erfc(np.minimum(x, 1))))


def _erfinv(y):
    z = np.clip(y, -1, 1)
    w = np.log1p(-z * z)
    a = 2 / (math.pi * 0.147) + w / 2
    x = np.sign(z) * np.sqrt(np.maximum(np.sqrt(a * a - w / 0.147) - a, 0))
    x = np.where(np.isfinite(x), x, 0)
    for _ in range(4):  # Newton's steps; near the ends over the small tail
        x = x + math.sqrt(math.pi) / 2 * np.where(np.abs(z) < 0.5, z - _erf(x), np.sign(z) * (_erfc(np.abs(x)) - (1 - np.abs(z)))) * np.exp(np.minimum(x * x, 700))
    return _choose(y, (np.isnan(y) | (np.abs(y) > 1), NAN), (np.abs(y) == 1, np.sign(y) * INF), (True, x))


# gamma function and its relatives
def _stirling(x):
    z = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / x


def _lgamma(x):
    up = np.where(x > 0, x, 1 - x)  # reflection below zero
    up = np.where(np.isfinite(up), up, 1.0)
    lift, y = np.zeros_like(up), up.copy()
    for _ in range(12):
        low = y < 12
        lift = lift + np.where(low, np.log(np.where(low, y, 1)), 0)
        y = y + low
    value = _stirling(y) - lift
    mirror = math.log(math.pi) - np.log(np.abs(np.sin(math.pi * (x - np.floor(x))))) - value
    return _choose(x, (np.isnan(x), NAN), (np.isinf(x) | ((x <= 0) & (x == np.floor(x))), INF), (x > 0, value), (True, mirror))


def _zeta(s, q):
    """Hurwitz zeta by Euler and Maclaurin: ten terms, then the integral and its corrections."""
    n = 10
    ok = (s > 1) & ((q > 0) | ((q != np.floor(q)) & (s == np.floor(s))))
    s1, q1 = np.where(ok, s, 2.0), np.where(ok, q, 1.0)
    total = sum(np.sign(q1 + k) ** np.where(s1 == np.floor(s1), s1, 0) * np.abs(q1 + k) ** -s1 for k in range(n))
    a = q1 + n
    total = total + a ** (1 - s1) / (s1 - 1) + 0.5 * a**-s1
    term = s1 * a ** (-s1 - 1)
    for j, b in enumerate((1 / 12, -1 / 720, 1 / 30240, -1 / 1209600, 1 / 47900160)):
        total = total + b * term
        term = term * (s1 + 2 * j + 1) * (s1 + 2 * j + 2) / (a * a)
    return _choose(s, (np.isnan(s) | np.isnan(q) | (s < 1), NAN), (s == 1, INF), ((q <= 0) & (q == np.floor(q)), INF), (ok, total), (True, NAN))


def _digamma(x):
    y = np.where(x > 0, x, 1 - x)
    y = np.where(np.isfinite(y), y, 1.0)
    out = np.zeros_like(y)
    for _ in range(12):
        low = y < 12
        out = out - np.where(low, 1 / np.where(low, y, 1), 0)
        y = y + low
    z = 1 / (y * y)
    out = out + np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    return _choose(x, (np.isnan(x) | (x == -INF), NAN), (x == INF, INF), (x == 0, -np.copysign(INF, x)), (x > 0, out), (x == np.floor(x), NAN), (True, out - math.pi / np.tan(math.pi * x)))


def polygamma(n: int, x):
    """The n-th derivative of digamma, n >= 0."""
    if n == 0:
        return digamma(x)
    return F.lit((-1.0) ** (n + 1) * math.factorial(n)) * zeta(n + 1.0, x)


def mvlgamma(x, p: int):
    """Log of the multivariate gamma function of dimension p."""
    total = F.lit(p * (p - 1) / 4 * math.log(math.pi))
    for j in range(p):
        total = total + lgamma(x - j / 2)
    return total


def _igamma(a, x):
    """Regularised lower incomplete gamma function: series below, the upper one's integral above."""
    ok = (a > 0) & (x > 0) & np.isfinite(a) & np.isfinite(x)
    a1, x1 = np.where(ok, a, 1.0), np.where(ok, x, 1.0)
    scale = np.exp(a1 * np.log(x1) - x1 - _lgamma(a1))
    term = total = 1 / a1
    low = x1 < a1 + 1
    for k in range(1, 400):
        term = term * np.where(low, x1, 0) / (a1 + k)
        total = total + term
        if (term <= total * 1e-17).all():
            break
    tiny = 1e-300  # Lentz's continued fraction of the upper function
    b = x1 + 1 - a1
    b = np.where(low, 1.0, b)
    c, d = np.full_like(b, 1 / tiny), 1 / b
    h = d.copy()
    for k in range(1, 400):
        an = -k * (k - a1)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        if (low | (np.abs(d * c - 1) < 1e-16)).all():
            break
    value = np.where(low, scale * total, 1 - scale * h)
    return _choose(a, (np.isnan(a) | np.isnan(x) | (a < 0) | (x < 0) | ((a == 0) & (x == 0)), NAN), (a == 0, 1.0), (x == 0, 0.0), (np.isinf(a), np.where(np.isinf(x), NAN, 0.0)), (np.isinf(x), 1.0), (True, value))


# Bessel functions
def _i_scaled(order, x):
    """exp(-|x|) I(x): the mean of exp(x cos t) cos(order t)."""
    n = 64
    far = np.abs(x) > 30  # more points where the integrand is narrow
    t = (np.arange(n) + 0.5) * math.pi / n
    near = _over(lambda x, t: np.exp(x * np.cos(t) - np.abs(x)) * np.cos(order * t), np.where(far, 0, x), t, np.full(n, 1 / n))
    y = np.where(far, np.abs(x), 100.0)
    m, term, total = 4 * order * order, np.ones_like(y), np.ones_like(y)
    for k in range(1, 16):  # Hankel's expansion
        term = term * -(m - (2 * k - 1) ** 2) / (8 * k * y)
        total = total + term
    wide = total / np.sqrt(2 * math.pi * y) * np.where((x < 0) & (order % 2 == 1), -1, 1)
    return np.where(np.isnan(x), NAN, np.where(far, wide, near))


def _hankel(order, x):
    """P and Q of the expansion for large x."""
    m, p, q, term = 4 * order * order, np.ones_like(x), np.zeros_like(x), np.ones_like(x)
    for k in range(1, 14):
        term = term * (m - (2 * k - 1) ** 2) / (8 * k * x)
        if k % 2:
            q = q + (-1) ** (k // 2) * term
        else:
            p = p + (-1) ** (k // 2) * term
    return p, q


def _j(order, x):
    far = np.abs(x) > 30
    n = 96
    t = (np.arange(n) + 0.5) * math.pi / n
    near = _over(lambda x, t: np.cos(order * t - x * np.sin(t)), np.where(far, 0, x), t, np.full(n, 1 / n))
    y = np.where(far, np.abs(x), 100.0)
    p, q = _hankel(order, y)
    a = y - order * math.pi / 2 - math.pi / 4
    wide = np.sqrt(2 / (math.pi * y)) * (p * np.cos(a) - q * np.sin(a)) * np.where((x < 0) & (order % 2 == 1), -1, 1)
    return _choose(x, (np.isnan(x), NAN), (np.isinf(x), 0.0), (far, wide), (True, near))


def _y(order, x):
    far = x > 30
    y = np.where((x > 0) & ~far, x, 1.0)
    t, w = _gauss(80)
    first = _over(lambda x, t: np.sin(x * np.sin((t + 1) * math.pi / 2) - order * (t + 1) * math.pi / 2), y, t, w / 2)
    s = np.arange(1, 400) * 0.05  # the integrand dies out doubly exponentially
    h = np.r_[0.5, np.ones(len(s))] * 0.05
    s = np.r_[0.0, s]
    second = _over(lambda x, s: (np.exp(order * s) + (-1) ** order * np.exp(-order * s)) * np.exp(-x * np.sinh(s)), y, *_tail(s, h))
    p, q = _hankel(order, np.where(far, x, 100.0))
    z = np.where(far, x, 100.0)
    a = z - order * math.pi / 2 - math.pi / 4
    wide = np.sqrt(2 / (math.pi * z)) * (p * np.sin(a) + q * np.cos(a))
    return _choose(x, (np.isnan(x) | (x < 0), NAN), (x == 0, -INF), (np.isinf(x), 0.0), (far, wide), (True, first - second / math.pi))


def _tail(s, h):
    """Gauss points in intervals of a half-line up to 20, for an integrand that isn't even at 0."""
    t, w = _gauss(20)
    edge = np.arange(0, 20, 0.5)
    return (edge[:, None] + (t + 1) / 4).reshape(-1), np.tile(w / 4, len(edge))


def _k_scaled(order, x):
    """exp(x) K(x): the integral of exp(-x (cosh t - 1)) cosh(order t)."""
    y = np.where(x > 0, x, 1.0)
    t = np.arange(0, 1200) * 0.02
    w = np.full(len(t), 0.02)
    w[0] = 0.01
    value = _over(lambda x, t: np.exp(-x * (np.cosh(t) - 1)) * np.cosh(order * t), np.minimum(y, 1e6), t, w, 512)
    value = np.where(y > 1e3, np.sqrt(math.pi / (2 * y)) * (1 + (4 * order * order - 1) / (8 * y)), value)
    return _choose(x, (np.isnan(x) | (x < 0), NAN), (x == 0, INF), (True, value))


def _airy_ai(x):
    """By K of order a third for x > 0, by J of orders a third and minus a third below: both as integrals."""
    z = np.minimum(np.abs(x), 100.0) ** 1.5 * 2 / 3
    t = np.arange(0, 1200) * 0.02
    w = np.full(len(t), 0.02)
    w[0] = 0.01
    right = np.where(x > 0, z, 1.0)
    k = _over(lambda z, t: np.exp(-z * np.cosh(t)) * np.cosh(t / 3), np.maximum(right, 1e-12), t, w, 512)
    up = np.sqrt(np.maximum(x, 0) / 3) / math.pi * k
    # the Taylor series about 0, near it and for moderate negative x
    near = np.where(np.abs(x) < 6, x, 0.0)
    f, g, tf, tg = np.ones_like(x), near.copy(), np.ones_like(x), near.copy()
    for n in range(1, 60):
        tf = tf * near**3 / ((3 * n - 1) * (3 * n))
        tg = tg * near**3 / ((3 * n) * (3 * n + 1))
        f, g = f + tf, g + tg
    series = 0.355028053887817239 * f - 0.258819403792806798 * g
    far = np.where(x < -6, z, 100.0)  # the expansion for large negative x
    u, p, q = np.ones_like(x), np.ones_like(x), np.zeros_like(x)
    for n in range(1, 12):
        u = u * (6 * n - 5) * (6 * n - 3) * (6 * n - 1) / (216 * n * (2 * n - 1)) / far
        if n % 2:
            q = q + (-1) ** (n // 2) * u
        else:
            p = p + (-1) ** (n // 2) * u
    a = far - math.pi / 4
    down = (np.cos(a) * p + np.sin(a) * q) / (math.sqrt(math.pi) * np.where(x < -6, -x, 1.0) ** 0.25)
    return _choose(x, (np.isnan(x), NAN), (np.isinf(x), 0.0), (x > 2, up), (x < -6, down), (True, series))


def _log_ndtr(x):
    y = -x / math.sqrt(2)
    return np.where(x < -1, np.log(_erfcx(np.maximum(y, 0.5)) / 2) - y * y, np.log1p(-_erfc(np.maximum(-y, -0.75)) / 2))


erf, erfc, erfcx, erfinv = _vector(lambda x: _erf(x)), _vector(lambda x: _erfc(x)), _vector(lambda x: _erfcx(x)), _vector(lambda y: _erfinv(y))
lgamma, digamma, zeta = _vector(lambda x: _lgamma(x)), _vector(lambda x: _digamma(x)), _vector(lambda s, q: _zeta(s, q))
igamma, igammac = _vector(lambda a, x: _igamma(a, x)), _vector(lambda a, x: 1 - _igamma(a, x))
i0e, i1e = _vector(lambda x: _i_scaled(0, x)), _vector(lambda x: _i_scaled(1, x))
i0, i1 = _vector(lambda x: _i_scaled(0, x) * np.exp(np.abs(x))), _vector(lambda x: _i_scaled(1, x) * np.exp(np.abs(x)))
bessel_j0, bessel_j1 = _vector(lambda x: _j(0, x)), _vector(lambda x: _j(1, x))
bessel_y0, bessel_y1 = _vector(lambda x: _y(0, x)), _vector(lambda x: _y(1, x))
k0e, k1e = _vector(lambda x: _k_scaled(0, x)), _vector(lambda x: _k_scaled(1, x))
k0, k1 = _vector(lambda x: _k_scaled(0, x) * np.exp(-x)), _vector(lambda x: _k_scaled(1, x) * np.exp(-x))
airy_ai = _vector(lambda x: _airy_ai(x))
ndtri = _vector(lambda p: math.sqrt(2) * _erfinv(2 * p - 1))
log_ndtr = _vector(lambda x: _log_ndtr(x))
nextafter = _vector(lambda x, y: np.nextafter(x, y))


def gelu(x):
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def gelu_backward(g, x):
    return g * (0.5 * (1 + erf(x / math.sqrt(2))) + x * F.exp(-x * x / 2) / math.sqrt(2 * math.pi))


def kaiser_window(i, n: int, beta: float = 12.0):
    """Value i of n of the symmetric window."""
    at = 2 * i / (n - 1) - 1
    return i0(beta * F.sqrt(F.greatest(1 - at * at, F.lit(0.0)))) / i0(F.lit(beta))

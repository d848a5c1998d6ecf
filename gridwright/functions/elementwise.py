"""Elementwise tensor operators as Column expressions with IEEE results: NaN spreads, division by zero is infinite."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _d(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def _nan(x: Column, out: Column) -> Column:
    return F.when(F.isnan(x), F.lit(NAN)).otherwise(out)


# arithmetic
def add(a, b, alpha=1): return _d(a) + F.lit(float(alpha)) * _d(b)
def sub(a, b, alpha=1): return _d(a) - F.lit(float(alpha)) * _d(b)
def rsub(a, b, alpha=1): return sub(b, a, alpha)
def mul(a, b): return _d(a) * _d(b)
def neg(a): return -_d(a)


def div(a, b, rounding=None):
    a, b = _d(a), _d(b)
    zero = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)
    q = F.when(b != 0, F.try_divide(a, b)).otherwise(zero)
    return trunc(q) if rounding == "trunc" else floor_divide(a, b) if rounding == "floor" else q


def fmod(a, b):
    a, b = _d(a), _d(b)
    return F.when(b == 0, F.lit(NAN)).otherwise(F.try_mod(a, b))


def remainder(a, b):
    b, m = _d(b), fmod(a, b)
    return F.when((m != 0) & ((m < 0) != (b < 0)), m + b).otherwise(m)


def floor_divide(a, b):
    a, b = _d(a), _d(b)
    return F.when(b == 0, div(a, b)).otherwise(F.rint(F.try_divide(a - remainder(a, b), b)))


def reciprocal(x): return div(F.lit(1.0), x)
def abs_(x): return F.abs(x)
def floor(x): return F.when(F.isnan(_d(x)) | (F.abs(_d(x)) >= 2.0**53), _d(x)).otherwise(F.floor(_d(x)).cast("double"))
def ceil(x): return F.when(F.isnan(_d(x)) | (F.abs(_d(x)) >= 2.0**53), _d(x)).otherwise(F.ceil(_d(x)).cast("double"))
def trunc(x): return F.when(_d(x) < 0, ceil(x)).otherwise(floor(x))
def frac(x): return _d(x) - trunc(x)
def round_(x, decimals=0): return F.rint(_d(x)) if not decimals else F.bround(_d(x), decimals)
def sign(x): return F.when(F.isnan(_d(x)), 0.0).otherwise(F.signum(_d(x)))
def sqrt(x): return F.sqrt(_d(x))
def rsqrt(x): return reciprocal(F.sqrt(_d(x)))
def square(x): return _d(x) * _d(x)


# exponentials and logarithms
def _log(x, f, at=0.0):
    x = _d(x)
    return F.when(F.isnan(x) | (x < at), F.lit(NAN)).when(x == at, F.lit(-INF)).otherwise(f(x))


def log(x): return _log(x, F.log)
def log2(x): return _log(x, F.log2)
def log10(x): return _log(x, F.log10)
def log1p(x): return _log(x, F.log1p, -1.0)
def exp(x): return F.exp(_d(x))
def exp2(x): return F.pow(F.lit(2.0), _d(x))
def expm1(x): return F.expm1(_d(x))
def pow_(a, b): return F.pow(_d(a), _d(b))
def xlogy(x, y): return F.when(F.isnan(_d(y)), NAN).when(_d(x) == 0, 0.0).otherwise(_d(x) * log(y))
def xlog1py(x, y): return F.when(F.isnan(_d(y)), NAN).when(_d(x) == 0, 0.0).otherwise(_d(x) * log1p(y))
def logaddexp(a, b):
    a, b = _d(a), _d(b)
    return F.when((a == b) & (F.abs(a) == INF), a).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))
def logaddexp2(a, b): return logaddexp(_d(a) * math.log(2), _d(b) * math.log(2)) / math.log(2)
def logit(x, eps=None):
    x = _d(x) if eps is None else clamp(x, eps, 1 - eps)
    return log(div(x, 1 - x))
def entr(x): return F.when(F.isnan(_d(x)), NAN).when(_d(x) > 0, -_d(x) * F.log(_d(x))).when(_d(x) == 0, 0.0).otherwise(-INF)


# trigonometry
def sin(x): return F.sin(x)
def cos(x): return F.cos(x)
def tan(x): return F.tan(x)
def asin(x): return F.asin(x)
def acos(x): return F.acos(x)
def atan(x): return F.atan(x)
def sinh(x): return F.sinh(x)
def cosh(x): return F.cosh(x)
def tanh(x): return F.tanh(x)
def asinh(x): return F.asinh(x)
def acosh(x): return F.acosh(x)
def atanh(x): return F.atanh(x)
def atan2(a, b):
    """Spark's own takes -0.0 for 0.0."""
    a, b = _d(a), _d(b)
    flat = copysign(F.when(signbit(b), math.pi).otherwise(0.0), a)
    return F.when((a == 0) & ~F.isnan(b), flat).otherwise(F.atan2(a, b))
def hypot(a, b): return F.hypot(_d(a), _d(b))
def rad2deg(x): return F.degrees(_d(x))
def deg2rad(x): return F.radians(_d(x))
def sinc(x): return F.when(_d(x) == 0, 1.0).otherwise(div(F.sin(_d(x) * math.pi), _d(x) * math.pi))
def spherical_bessel_j0(x): return F.when(_d(x) == 0, 1.0).otherwise(div(F.sin(_d(x)), x))


# limits and choices
def maximum(a, b): return F.greatest(_d(a), _d(b))
def minimum(a, b): return F.when(F.isnan(_d(a)) | F.isnan(_d(b)), NAN).otherwise(F.least(_d(a), _d(b)))
def fmax(a, b): return F.greatest(F.nanvl(_d(a), _d(b)), F.nanvl(_d(b), _d(a)))
def fmin(a, b): return F.least(F.nanvl(_d(a), _d(b)), F.nanvl(_d(b), _d(a)))
def clamp(x, lo=None, hi=None):
    x = _d(x)
    x = x if lo is None else maximum(x, _d(lo))
    return x if hi is None else minimum(x, _d(hi))
def nan_to_num(x, nan=0.0, pos=1.7976931348623157e308, minus=-1.7976931348623157e308):
    return F.when(F.isnan(_d(x)), nan).when(_d(x) == INF, pos).when(_d(x) == -INF, minus).otherwise(_d(x))
def heaviside(x, at): return F.when(F.isnan(_d(x)) | (_d(x) < 0), 0.0).when(_d(x) > 0, 1.0).otherwise(_d(at))
def copysign(a, b): return F.when(F.startswith(_d(b).cast("string"), F.lit("-")), -F.abs(_d(a))).otherwise(F.abs(_d(a)))
def lerp(a, b, w): return _d(a) + _d(w) * (_d(b) - _d(a))
def addcmul(a, b, c, value=1): return _d(a) + float(value) * _d(b) * _d(c)
def addcdiv(a, b, c, value=1): return _d(a) + float(value) * div(b, c)
def gcd(a, b):
    pair = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step)["a"]  # Euclid ends within 92 steps on 64 bits
def lcm(a, b):
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.abs(a.cast("long") * F.call_function("div", b.cast("long"), g)))


# comparisons: nothing compares with NaN
def _ok(a, b): return ~F.isnan(_d(a)) & ~F.isnan(_d(b))
def eq(a, b): return _ok(a, b) & (_d(a) == _d(b))
def ne(a, b): return ~eq(a, b)
def lt(a, b): return _ok(a, b) & (_d(a) < _d(b))
def le(a, b): return _ok(a, b) & (_d(a) <= _d(b))
def gt(a, b): return _ok(a, b) & (_d(a) > _d(b))
def ge(a, b): return _ok(a, b) & (_d(a) >= _d(b))
def isinf(x): return F.abs(_d(x)) == INF
def isposinf(x): return _d(x) == INF
def isneginf(x): return _d(x) == -INF
def signbit(x): return copysign(F.lit(1.0), x) < 0
def where(c, a, b): return F.when(c, a).otherwise(b)
def masked_fill(x, mask, v): return F.when(mask, F.lit(v)).otherwise(x)
def logical_not(a): return a == 0
def logical_and(a, b): return (a != 0) & (b != 0)
def logical_or(a, b): return (a != 0) | (b != 0)
def logical_xor(a, b): return (a != 0) != (b != 0)
def bitwise_and(a, b): return a.bitwiseAND(b)
def bitwise_or(a, b): return a.bitwiseOR(b)
def bitwise_xor(a, b): return a.bitwiseXOR(b)
def bitwise_not(a): return F.bitwise_not(a)
def left_shift(a, n): return F.call_function("shiftleft", a, n)
def right_shift(a, n): return F.call_function("shiftright", a, n)


# activations
def sigmoid(x): return 1 / (1 + F.exp(-_d(x)))
def relu(x): return F.greatest(_d(x), F.lit(0.0))
def relu6(x): return clamp(x, 0, 6)
def threshold(x, t, v): return F.when(_d(x) <= t, F.lit(float(v))).otherwise(_d(x))
def elu(x, a=1.0): return F.when(_d(x) > 0, _d(x)).otherwise(a * F.expm1(_d(x)))
def silu(x): return _d(x) / (1 + F.exp(-_d(x)))
def mish(x): return _d(x) * F.tanh(softplus(x))
def softplus(x, b=1.0, t=20.0): return F.when(b * _d(x) > t, _d(x)).otherwise(F.log1p(F.exp(b * _d(x))) / b)
def hardtanh(x, lo=-1, hi=1): return clamp(x, lo, hi)
def hardsigmoid(x): return clamp(_d(x) + 3, 0, 6) / 6
def hardswish(x): return _d(x) * hardsigmoid(x)
def leaky_relu(x, s=0.01): return F.when(_d(x) > 0, _d(x)).otherwise(s * _d(x))
def prelu(x, w): return F.when(_d(x) > 0, _d(x)).otherwise(_d(w) * _d(x))
def softshrink(x, l=0.5): return F.when(F.isnan(_d(x)), NAN).when(_d(x) > l, _d(x) - l).when(_d(x) < -l, _d(x) + l).otherwise(0.0)
def hardshrink(x, l=0.5): return F.when(F.abs(_d(x)) <= l, 0.0).otherwise(_d(x))
def log_sigmoid(x): return F.least(_d(x), F.lit(0.0)) - F.log1p(F.exp(-F.abs(_d(x))))
def gelu_tanh(x): return 0.5 * _d(x) * (1 + F.tanh(math.sqrt(2 / math.pi) * (_d(x) + 0.044715 * F.pow(_d(x), F.lit(3.0)))))
def glu(a, b): return _d(a) * sigmoid(b)


# gradients of activations: g is the gradient that comes in
def sigmoid_backward(g, y): return _d(g) * _d(y) * (1 - _d(y))
def tanh_backward(g, y): return _d(g) * (1 - _d(y) * _d(y))
def threshold_backward(g, x, t): return F.when(_d(x) <= t, 0.0).otherwise(_d(g))
def elu_backward(g, x, a=1.0): return F.when(_d(x) > 0, _d(g)).otherwise(_d(g) * a * F.exp(_d(x)))
def silu_backward(g, x): return _d(g) * sigmoid(x) * (1 + _d(x) * (1 - sigmoid(x)))
def softplus_backward(g, x, b=1.0, t=20.0): return F.when(b * _d(x) > t, _d(g)).otherwise(_d(g) * sigmoid(b * _d(x)))
def hardtanh_backward(g, x, lo=-1, hi=1): return F.when((_d(x) <= lo) | (_d(x) >= hi), 0.0).otherwise(_d(g))
def hardsigmoid_backward(g, x): return F.when((_d(x) > -3) & (_d(x) < 3), _d(g) / 6).otherwise(0.0)
def leaky_relu_backward(g, x, s=0.01): return F.when(_d(x) > 0, _d(g)).otherwise(s * _d(g))
def softshrink_backward(g, x, l=0.5): return F.when(F.abs(_d(x)) <= l, 0.0).otherwise(_d(g))
def log_sigmoid_backward(g, x): return _d(g) * (1 - sigmoid(x))
def logit_backward(g, x): return div(g, _d(x) * (1 - _d(x)))


# polynomials by their three-term recurrences, for whole degrees n >= 0
def _recur(x, n, first, second, step):
    x = _d(x)
    start = F.struct(_d(first(x)).alias("a"), _d(second(x)).alias("b"))
    run = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(n), F.lit(2))), start, lambda s, k: F.struct(s["b"].alias("a"), step(x, k, s["a"], s["b"]).alias("b")))
    return _d(first(x)) if n == 0 else _d(second(x)) if n == 1 else run["b"]


_one = lambda x: F.lit(1.0)
def chebyshev_t(x, n): return _recur(x, n, _one, lambda x: x, lambda x, k, a, b: 2 * x * b - a)
def chebyshev_u(x, n): return _recur(x, n, _one, lambda x: 2 * x, lambda x, k, a, b: 2 * x * b - a)
def chebyshev_v(x, n): return _recur(x, n, _one, lambda x: 2 * x - 1, lambda x, k, a, b: 2 * x * b - a)
def chebyshev_w(x, n): return _recur(x, n, _one, lambda x: 2 * x + 1, lambda x, k, a, b: 2 * x * b - a)
def shifted_chebyshev_t(x, n): return chebyshev_t(2 * _d(x) - 1, n)
def hermite_h(x, n): return _recur(x, n, _one, lambda x: 2 * x, lambda x, k, a, b: 2 * x * b - 2 * (k - 1) * a)
def hermite_he(x, n): return _recur(x, n, _one, lambda x: x, lambda x, k, a, b: x * b - (k - 1) * a)
def laguerre_l(x, n): return _recur(x, n, _one, lambda x: 1 - x, lambda x, k, a, b: ((2 * k - 1 - x) * b - (k - 1) * a) / k)
def legendre_p(x, n): return _recur(x, n, _one, lambda x: x, lambda x, k, a, b: ((2 * k - 1) * x * b - (k - 1) * a) / k)
def shifted_chebyshev_u(x, n): return chebyshev_u(2 * _d(x) - 1, n)
def shifted_chebyshev_v(x, n): return chebyshev_v(2 * _d(x) - 1, n)
def shifted_chebyshev_w(x, n): return chebyshev_w(2 * _d(x) - 1, n)


# more gradients
def hardswish_backward(g, x): return F.when(_d(x) <= -3, 0.0).when(_d(x) < 3, _d(g) * (_d(x) / 3 + 0.5)).otherwise(_d(g))
def mish_backward(g, x):
    t = F.tanh(softplus(x))
    return _d(g) * (t + _d(x) * sigmoid(x) * (1 - t * t))
def gelu_tanh_backward(g, x):
    x, k = _d(x), math.sqrt(2 / math.pi)
    t = F.tanh(k * (x + 0.044715 * x * x * x))
    return _d(g) * (0.5 * (1 + t) + 0.5 * x * (1 - t * t) * k * (1 + 3 * 0.044715 * x * x))
def glu_backward(g, a, b):
    """Gradients of both halves."""
    s = sigmoid(b)
    return F.struct((_d(g) * s).alias("a"), (_d(g) * _d(a) * s * (1 - s)).alias("b"))
def glu_jvp(da, db, a, b):
    """Tangent of glu for tangents of both halves."""
    s = sigmoid(b)
    return _d(da) * s + _d(a) * s * (1 - s) * _d(db)
def glu_backward_jvp(dg, g, da, db, a, b):
    """Tangent of glu's gradients for tangents of the gradient that comes in and of both halves."""
    s = sigmoid(b)
    slope = s * (1 - s)
    first = _d(dg) * s + _d(g) * slope * _d(db)
    second = _d(dg) * _d(a) * slope + _d(g) * _d(da) * slope + _d(g) * _d(a) * slope * (1 - 2 * s) * _d(db)
    return F.struct(first.alias("a"), second.alias("b"))
def hardshrink_backward(g, x, l=0.5): return softshrink_backward(g, x, l)
def prelu_backward(g, x, w):
    """Gradients of the input and of the weight."""
    return F.struct(F.when(_d(x) > 0, _d(g)).otherwise(_d(w) * _d(g)).alias("x"), F.when(_d(x) > 0, 0.0).otherwise(_d(x) * _d(g)).alias("w"))
def rrelu_with_noise(x, noise): return F.when(_d(x) <= 0, _d(x) * _d(noise)).otherwise(_d(x))
def rrelu_with_noise_backward(g, x, noise): return F.when(_d(x) <= 0, _d(g) * _d(noise)).otherwise(_d(g))
def dropout_backward(g, mask, scale): return F.when(mask, _d(g) * float(scale)).otherwise(0.0)
def masked_scale(x, mask, scale): return F.when(mask, _d(x) * float(scale)).otherwise(0.0)
def mse_backward(g, a, b): return 2 * _d(g) * (_d(a) - _d(b))
def smooth_l1_backward(g, a, b, beta=1.0):
    x = _d(a) - _d(b)
    return F.when(x <= -beta, -_d(g)).when(x >= beta, _d(g)).otherwise(_d(g) * x / beta)
def huber_backward(g, a, b, delta=1.0):
    x = _d(a) - _d(b)
    return F.when(x <= -delta, -delta * _d(g)).when(x >= delta, delta * _d(g)).otherwise(_d(g) * x)
def bce_backward(g, p, y): return div(_d(g) * (_d(p) - _d(y)), F.greatest((1 - _d(p)) * _d(p), F.lit(1e-12)))


# complex numbers: structs of re and im
def complex_(re, im): return F.struct(_d(re).alias("re"), _d(im).alias("im"))
def polar(size, angle): return complex_(_d(size) * F.cos(_d(angle)), _d(size) * F.sin(_d(angle)))
def view_as_real(z): return F.array(z["re"], z["im"])
def view_as_complex(a): return complex_(F.get(a, F.lit(0)), F.get(a, F.lit(1)))
def conj(z): return complex_(z["re"], -z["im"])
def complex_abs(z): return F.hypot(z["re"], z["im"])
def angle(z):
    """Of a complex number, or of a real one: 0 or pi, NaN for NaN."""
    if isinstance(z, tuple):
        return F.when(F.isnan(z[0]), NAN).when(_d(z[0]) < 0, math.pi).otherwise(0.0)
    return F.atan2(z["im"], z["re"])
def sgn(z):
    """z over its size; 0 stays 0."""
    n = complex_abs(z)
    return complex_(F.when(n == 0, 0.0).otherwise(div(z["re"], n)), F.when(n == 0, 0.0).otherwise(div(z["im"], n)))


# parts of the floating-point form
def frexp(x):
    """Mantissa in [0.5, 1) with the sign, and exponent; 0, infinities and NaN are their own mantissas with exponent 0."""
    x = _d(x)
    guess = (F.floor(F.log2(F.abs(x))) + 1).cast("int")
    odd = (x == 0) | F.isnan(x) | (F.abs(x) == INF)
    half = lambda n: F.floor(n / 2).cast("int")
    over = lambda n: x / F.pow(F.lit(2.0), half(n)) / F.pow(F.lit(2.0), n - half(n))  # in two steps: 2**1024 is infinite
    scaled = over(guess)  # the logarithm may be off by one next to a power of two
    fixed = F.when(F.abs(scaled) >= 1, guess + 1).when(F.abs(scaled) < 0.5, guess - 1).otherwise(guess)
    return F.struct(F.when(odd, x).otherwise(over(fixed)).alias("mantissa"), F.when(odd, 0).otherwise(fixed).cast("int").alias("exponent"))
def ldexp(x, n):
    """In three steps, each a power of two in range, so that nothing but the result overflows or vanishes."""
    n = F.greatest(F.least(_d(n), F.lit(2200.0)), F.lit(-2200.0))
    third = F.rint(n / 3)
    return _d(x) * F.pow(F.lit(2.0), third) * F.pow(F.lit(2.0), third) * F.pow(F.lit(2.0), n - 2 * third)


def foreach(f, columns, *others):
    """f over a list of columns; each further argument is a list of as many, or one value for all."""
    rest = [o if isinstance(o, (list, tuple)) else [o] * len(columns) for o in others]
    return [f(c, *(o[i] for o in rest)) for i, c in enumerate(columns)]

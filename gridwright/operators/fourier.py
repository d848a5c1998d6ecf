"""Fourier transforms of arrays in rows, of any length and along any dimension, in n log n steps.

The length is cut into factors of at most LARGEST; a stage for each joins that many interleaved transforms into one, for all rows of a batch at once.
A length with a larger prime factor goes by chirps: a convolution through transforms of a power of two.
"""

from __future__ import annotations

import cmath
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 7
#: Numbers that are transformed at a time.
CHUNK = 1 << 19
COMPLEX = "array<struct<re:double,im:double>>"


def factors(n: int) -> list[int] | None:
    """Radices whose product is n, fours before twos; None where a prime factor is over LARGEST."""
    out = []
    for p in (4, 2, 3, 5, 7):
        while n % p == 0:
            out.append(p)
            n //= p
    return out if n == 1 else None


def complex_of(values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(x.cast("double").alias("re"), F.lit(0.0).alias("im")))


def _roots(n: int, sign: int) -> np.ndarray:
    return np.array([cmath.exp(sign * 2j * math.pi * k / n) for k in range(n)])


def _stages(x: np.ndarray, sign: int) -> np.ndarray:
    """The transforms of the rows of x. After a stage, `done` numbers lie beside each other for each of the `left` starts of what is to be joined."""
    (rows, n), done = x.shape, 1
    w = _roots(n, sign)
    for p in factors(n):
        left = n // (done * p)
        parts = x.reshape(rows, p, left, done)
        x = np.empty((rows, left, p, done), complex)
        for v in range(p):
            total = parts[:, 0].copy()
            for u in range(1, p):
                total += parts[:, u] * w[u * v * (n // p) % n]
            x[:, :, v] = total * w[np.arange(left) * v * done % n][:, None]
        done *= p
    return x.reshape(rows, n)


def _plain(values: list[complex], sign: int) -> list[complex]:
    """Transform of a power of two of numbers, for the table of a chirp."""
    n = len(values)
    if n == 1:
        return values
    even, odd = _plain(values[::2], sign), _plain(values[1::2], sign)
    turned = [cmath.exp(sign * 2j * math.pi * k / n) * x for k, x in enumerate(odd)]
    return [a + b for a, b in zip(even, turned, strict=True)] + [a - b for a, b in zip(even, turned, strict=True)]


def _chirped(x: np.ndarray, sign: int) -> np.ndarray:
    """As _stages, for any n: x_k c_k convolved with the conjugate chirp, c_k = exp(sign i pi k^2 / n)."""
    n = x.shape[1]
    m = 1 << (2 * n - 1).bit_length()
    chirp = np.array([cmath.exp(sign * 1j * math.pi * (k * k % (2 * n)) / n) for k in range(n)])
    kernel = [0j] * m
    for k, c in enumerate(chirp):
        kernel[k] = kernel[-k] = complex(c.conjugate())
    line = np.zeros((len(x), m), complex)
    line[:, :n] = x * chirp
    return _stages(_stages(line, -1) * np.array(_plain(kernel, -1)), 1)[:, :n] / m * chirp


def _along(x: np.ndarray, known: np.ndarray | None, d: int, sign: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Both transformed along a dimension: what a missing number reaches is missing."""
    if x.shape[d] < 2:
        return x, known
    turned = np.moveaxis(x, d, -1)
    out = (_stages if factors(x.shape[d]) else _chirped)(np.ascontiguousarray(turned).reshape(-1, x.shape[d]), sign)
    out = np.moveaxis(out.reshape(turned.shape), -1, d)
    return out, None if known is None else np.broadcast_to(known.all(d, keepdims=True), known.shape)


def _numbers(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Lists of real or complex numbers as rows of `width`, and which numbers are there (None: all of them)."""
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    flat = values.flatten()
    parts = flat.flatten() if pa.types.is_struct(flat.type) else [flat]
    there = np.logical_and.reduce([p.is_valid().to_numpy(zero_copy_only=False) for p in parts])
    re, *im = (pc.fill_null(p, 0.0).to_numpy(zero_copy_only=False) for p in parts)
    flat = np.empty(len(re), complex)
    flat.real, flat.imag = re, im[0] if im else 0.0
    if (sizes == width).all() and there.all():
        return flat.reshape(-1, width), None
    out, known = np.zeros((len(sizes), width), complex), np.zeros((len(sizes), width), bool)
    placed, taken = np.arange(width) < sizes[:, None], np.arange(sizes.max(initial=0)) < sizes[:, None]
    kept = np.broadcast_to(np.arange(taken.shape[1]) < width, taken.shape)[taken]
    out[placed], known[placed] = flat[kept], there[kept]
    return out, known


def _lists(x: np.ndarray, known: np.ndarray | None, real: bool) -> pa.Array:
    mask = None if known is None else ~known.ravel()
    part = lambda v: pa.array(np.ascontiguousarray(v).ravel(), pa.float64(), mask=mask)
    values = part(x.real) if real else pa.StructArray.from_arrays([part(x.real), part(x.imag)], ["re", "im"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * math.prod(x.shape[1:]), pa.int32()), values)


def _mapped(df: DataFrame, values: Column, name: str, width: int, total: int, work: Callable, real: bool = False) -> DataFrame:
    """df with what work makes of the first `width` numbers of each row's list, some rows of `total` numbers at a time."""
    step = max(1, CHUNK // max(total, 1))

    @F.arrow_udf("array<double>" if real else COMPLEX)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = [_lists(*work(*_numbers(batch.slice(i, step), width)), real) for i in range(0, len(batch), step)]
            yield pa.concat_arrays(made) if made else _lists(np.zeros((0, 1), complex), None, real)

    return df.withColumn(name, run(values))


def _scale(size: int, inverse: bool, norm: str) -> float:
    return {"backward": 1 / size if inverse else 1.0, "forward": 1.0 if inverse else 1 / size, "ortho": 1 / math.sqrt(size)}[norm]


def fft(df: DataFrame, column: str, name: str, shape: list[int], dims: list[int] | None = None, inverse: bool = False, norm: str = "backward") -> DataFrame:
    """df with the transform of a complex array (structs re, im; numbers of `shape`, last dimension fastest) over some dimensions (all, if none are
    named), one after another. norm: backward (the inverse divides by n), forward (the other one does) or ortho (both by its root)."""
    dims, total = list(range(len(shape)) if dims is None else dims), math.prod(shape)
    scale = _scale(math.prod(shape[d] for d in dims), inverse, norm)

    def work(x: np.ndarray, known: np.ndarray | None):
        x, known = x.reshape(-1, *shape), None if known is None else known.reshape(-1, *shape)
        for d in dims:
            x, known = _along(x, known, d + 1, 1 if inverse else -1)
        return x * scale, known

    return _mapped(df, F.col(column).cast(COMPLEX), name, total, total, work)


def rfft(df: DataFrame, column: str, name: str, n: int, norm: str = "backward") -> DataFrame:
    """The first half of a real array's transform."""
    half, scale = n // 2 + 1, _scale(n, False, norm)

    def work(x: np.ndarray, known: np.ndarray | None):
        x, known = _along(x, known, 1, -1)
        return x[:, :half] * scale, None if known is None else known[:, :half]

    return _mapped(df, F.col(column).cast("array<double>"), name, n, n, work)


def irfft(df: DataFrame, column: str, name: str, n: int, norm: str = "backward") -> DataFrame:
    """The real array of n numbers of which `column` is the first half of the transform."""
    half, scale = n // 2 + 1, _scale(n, True, norm)
    rest = np.arange(n - half, 0, -1)  # places of the first half whose conjugates are the second

    def work(x: np.ndarray, known: np.ndarray | None):
        x = np.concatenate([x, x[:, rest].conj()], 1)
        x, known = _along(x, None if known is None else np.concatenate([known, known[:, rest]], 1), 1, 1)
        return x * scale, known

    return _mapped(df, F.col(column).cast(COMPLEX), name, half, n, work, True)

"""Words and word shingles of many texts at once, as 64-bit hashes. Runs inside tasks, on a few MB of text at a time.

A word's hash sums a pseudo-random number for each (place in the word, byte) and mixes the sum with the length. Unlike a polynomial modulo 2**64, for
which whole families of texts agree whatever its base, unequal words agree by chance alone (once in 2**64).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that a task turns into arrays at a time; they take some fifty times as much.
PIECE = 1 << 19
_PRIME = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SPACES = re.compile(rb"[\x20\x09-\x0d]")


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Places of a word that have numbers of their own; those of later places are mixed from them.
PLACES = 64


def _numbers(lane: int) -> np.ndarray:
    return mix(np.arange(1, 256 * PLACES + 1, dtype=U) + U(lane << 32))


_NUMBERS = [_numbers(0), _numbers(1)]


def sums(b: np.ndarray, starts: np.ndarray, lane: int = 0) -> np.ndarray:
    """sums[z] - sums[a]: of the numbers of the bytes from a to z, places counted from the last of `starts` before each. lane: 0 or 1, independent."""
    first = np.zeros(len(b), np.int64)
    first[starts] = starts
    place = np.arange(len(b)) - np.maximum.accumulate(first)
    number = _NUMBERS[lane][(place & (PLACES - 1)) << 8 | b]
    late = np.flatnonzero(place >= PLACES)
    if len(late):
        number[late] = mix(number[late] + (place[late] >> 6).astype(U) * U(_PRIME))
    return np.r_[U(0), np.cumsum(number)]


def batches(sizes: list[int], limit: int = PIECE) -> Iterator[slice]:
    """Runs of rows of about `limit` bytes together, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def texts_of(batch: pa.RecordBatch, column: str = "_text", limit: int = PIECE) -> Iterator[tuple[slice, list[bytes]]]:
    """Runs of a batch's rows of about `limit` bytes together, one row at least, with their texts (null: empty). One run is held at a time."""
    texts = batch.column(column)
    for s in batches(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), limit):
        yield s, [x or b"" for x in texts.slice(s.start, s.stop - s.start).cast(pa.binary()).to_pylist()]


def _pieces(blob: bytes) -> Iterator[bytes]:
    """A long text cut between words."""
    at = 0
    while len(blob) - at > PIECE:
        cut = _SPACES.search(blob, at + PIECE)
        if not cut:
            break
        yield blob[at : cut.start()]
        at = cut.end()
    yield blob[at:] if at else blob


def _hash_part(blobs: list[bytes], space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, words in each blob, and where each word starts in the joined bytes."""
    b = np.frombuffer(b"\n" + b"\n".join(blobs) + b"\n", np.uint8)
    gap = space[b]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    total = sums(b, starts)
    h = mix(total[ends] - total[starts] + (ends - starts).astype(U))
    edge = np.cumsum([1, *[len(x) + 1 for x in blobs]])
    return h, np.diff(np.searchsorted(starts, edge)), starts


def hash_words(blobs: list[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of the blob that each stands in. `space` marks the bytes between words."""
    found, owners = [], []
    parts = [(p, i) for i, x in enumerate(blobs) for p in _pieces(x)]
    for s in batches([len(p) for p, _ in parts]):
        h, n, _ = _hash_part([p for p, _ in parts[s]], space)
        found.append(h)
        owners.append(np.repeat(np.array([i for _, i in parts[s]], np.int64), n))
    if not found:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive elements."""
    n = max(len(h) - k + 1, 0)
    out = np.full(n, k, U)
    for j in range(k):
        out = mix(out * U(_PRIME) + h[j : j + n])
    return out


def shingles(blobs: list[bytes], k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles; with fewer words, all of them as one; without words none."""
    h, owner = hash_words(blobs)
    every = chain(h, k)
    edge = np.searchsorted(owner, np.arange(len(blobs) + 1))
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        else:
            out.append(chain(h[a:b], b - a) if b > a else np.zeros(0, U))
    return out

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)); the last term is the sum over all
pairs, in time linear in the features (the sum-of-squares identity).

Features of a text, all from the text itself: its distinct lower-cased words hashed to WORD_DIMS places, each weighing
1 / sqrt(distinct words); and statistics (share of capitals, digits, punctuation and symbols, word and line lengths,
repeated neighbours, words and lines, share of the commonest word, length as metadata), each cut into ten bins of
which one is on. Labels, language, source and doc_id are never features.

The model is fitted on the driver on SAMPLE labelled rows at most, those of the labels with the least hash of doc_id, and where their
doc_ids stand in several rows those with the least hash of doc_id and text: the sample is the same however the rows are dealt, and
its bound in memory is SAMPLE times the number of features, whatever the corpus. Scoring covers all rows and whole texts.

Cases: null and empty texts have no words and the statistics' first bins; with no usable labels every score is 0.5, with
one class only that class's rate, smoothed; several labels for a doc_id all count; rows whose label or doc_id is null
are not learnt from; a null doc_id counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, hash_words, mix, texts_of

SAMPLE = 2000
WORD_DIMS = 4096
RANK = 8
STEPS = 120
EDGES = {
    "capitals": [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8],
    "digits": [0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5],
    "punctuation": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "symbols": [0.0005, 0.001, 0.002, 0.005, 0.01, 0.03, 0.06, 0.1, 0.2],
    "word length": [2, 3, 4, 4.5, 5, 5.5, 6, 8, 12],
    "line length": [10, 20, 40, 80, 120, 200, 400, 800, 1600],
    "repeated neighbours": [0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
    "distinct words": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeated lines": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9],
    "commonest word": [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5],
    "length": [3, 4, 5, 6, 7, 8, 9, 10, 11],
}
DIMS = WORD_DIMS + 10 * len(EDGES)

_b = np.arange(256)
_UPPER, _DIGIT = (_b >= 65) & (_b <= 90), (_b >= 48) & (_b <= 57)
_LETTER = _UPPER | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
_PUNCT = (_b > 32) & (_b < 127) & ~_LETTER & ~_DIGIT
_SYMBOL = np.isin(_b, list(b"#$%&*@^|~<>{}[]\\_=+"))
_LINE = _b == 10
#: A bit for each class, and the columns to count.
_CLASSES = np.stack([_UPPER, _LETTER, _DIGIT, _PUNCT, _SYMBOL, _LINE])


def _shares(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) pairs, and the commonest hash's count for each owner."""
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    new = np.r_[True, (o[1:] != o[:-1]) | (x[1:] != x[:-1])] if len(o) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    counts = np.diff(np.r_[first, len(o)])
    top = np.zeros(n, np.int64)
    np.maximum.at(top, o[first], counts)
    return o[first], x[first], np.bincount(o[first], minlength=n), top


def features(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, feature numbers and values, row by row: words, then one bin of each statistic."""
    n = len(blobs)
    size = np.array([len(x) for x in blobs], np.int64)
    joined = np.frombuffer(b"".join(blobs), np.uint8)
    edge = np.r_[0, np.cumsum(size)]
    count = []
    for mask in _CLASSES:
        total = np.r_[0, np.cumsum(mask[joined], dtype=np.int64)]
        count.append(np.diff(total[edge]))
    upper, letter, digit, punct, symbol, newline = count
    h, owner = hash_words([x.lower() for x in blobs])
    words = np.bincount(owner, minlength=n)
    same = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=n) if len(h) else np.zeros(n, int)
    row, word, distinct, top = _shares(owner, h, n)
    lines, of = hash_words(blobs, _LINE)
    _, _, distinct_lines, _ = _shares(of, lines, n)
    all_lines = np.bincount(of, minlength=n)
    div = lambda a, b: a / np.maximum(b, 1)
    stats = {
        "capitals": div(upper, letter), "digits": div(digit, size), "punctuation": div(punct, size), "symbols": div(symbol, size),
        "word length": div(size, words), "line length": div(size, newline + 1), "repeated neighbours": div(same, words), "distinct words": div(distinct, words),
        "repeated lines": div(all_lines - distinct_lines, all_lines), "commonest word": div(top, words), "length": np.log(np.maximum(size, 1)),
    }
    bins = np.stack([WORD_DIMS + 10 * i + np.digitize(stats[k], e) for i, (k, e) in enumerate(EDGES.items())], axis=1)
    place = (mix(word) % U(WORD_DIMS)).astype(np.int64)
    value = 1 / np.sqrt(np.maximum(distinct, 1))[row]
    rows = np.r_[row, np.repeat(np.arange(n), len(EDGES))]
    return rows, np.r_[place, bins.reshape(-1)], np.r_[value, np.full(bins.size, 1 / len(EDGES) ** 0.5)]


@dataclass
class Machine:
    """A factorisation machine's weights."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray, places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(rows, self.linear[places] * values, minlength=n)
        for f in range(self.factors.shape[1]):
            vx = self.factors[places, f] * values
            z += (np.bincount(rows, vx, minlength=n) ** 2 - np.bincount(rows, vx * vx, minlength=n)) / 2
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 7) -> Machine:
    """Adam on the log loss with both classes weighing the same, over a dense matrix of the sample."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    m = Machine(0.0, np.zeros(d, np.float32), (rng.standard_normal((d, RANK)) * 0.01).astype(np.float32))
    good = y.sum()
    if not len(y) or good in (0, len(y)):
        if len(y):
            m.bias = float(np.log((good + 1) / (len(y) - good + 1)))
        m.factors[:] = 0
        return m
    weight = np.where(y > 0, len(y) / (2 * good), len(y) / (2 * (len(y) - good))).astype(np.float32) / len(y)
    squares = x * x
    params = [np.zeros(1, np.float32), m.linear, m.factors]
    moment, energy = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        bias, w, v = params
        inner = x @ v
        z = bias[0] + x @ w + ((inner**2).sum(1) - (squares @ (v * v)).sum(1)) / 2
        g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight).astype(np.float32)
        slopes = [np.array([g.sum()], np.float32), x.T @ g + 1e-5 * w, x.T @ (g[:, None] * inner) - v * (squares.T @ g)[:, None] + 1e-5 * v]
        for p, s, a, b in zip(params, slopes, moment, energy, strict=True):
            a += 0.1 * (s - a)
            b += 0.01 * (s * s - b)
            p -= 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Machine(float(params[0][0]), params[1], params[2])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) == 0


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for s, blobs in texts_of(batch):
            n = len(blobs)
            rows, places, values = features(blobs)
            order = np.argsort(rows, kind="stable")
            edge = np.searchsorted(rows[order], np.arange(n + 1))
            places, values = places[order].astype(np.int16), values[order].astype(np.float32)
            parts = [(places[a:b].tobytes(), values[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            columns = [pa.array([p[i] for p in parts], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(s.start, n) for c in ("_y", "_h")), *columns], ["_y", "_h", "_places", "_values"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> Machine:
    """Fit on the labelled rows that are not held out, `sample` of them at most (the least hashes)."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.select("_text", "_y", F.xxhash64("_id", F.coalesce("_text", F.lit(""))).alias("_h"))
    # rows that agree in hash and label are copies: whichever of them the bound takes, the sample is the same
    found = rows.mapInArrow(_extract, "_y int, _h long, _places binary, _values binary").orderBy("_h", "_y").limit(sample).collect()
    found.sort(key=lambda r: (r["_y"], bytes(r["_values"]), bytes(r["_places"])))  # the same sums whatever the order of arrival
    x = np.zeros((len(found), DIMS), np.float32)
    for row, r in zip(x, found, strict=True):
        np.add.at(row, np.frombuffer(r["_places"], np.int16), np.frombuffer(r["_values"], np.float32))
    return fit(x, np.array([r["_y"] for r in found], np.float32))


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; a column that has the name already is replaced. Only the text goes to Python, and only the score comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in texts:
            batch = pa.RecordBatch.from_arrays([x], ["_text"])
            yield pa.array(np.concatenate([np.zeros(0), *(shared.value.score(*features(blobs), len(blobs)) for _, blobs in texts_of(batch))]))

    return docs.withColumn(out, scores(F.col(text)))


#: A document is rejected below this score.
CUT = 0.3


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

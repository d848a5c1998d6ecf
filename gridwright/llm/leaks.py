"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment.

The benchmark is the query set and is taken in blocks of about BLOCK_BYTES; each block is held against all documents, whole.
A seed is two words of an item, next to each other or with one word between, and stands in a document in either form, so a
word replaced, dropped or put in between doesn't hide it. A seed found in a document marks a window, and windows with
enough of the item's words are aligned with it: a word that agrees scores 1, a word replaced, dropped or put in costs 0.5.
The score is the best local alignment over the item's length, and pairs that reach CUT are returned.

No such pair is lost, for items of three words or more. With n words, M that agree and E edits between them, CUT asks for
M - E / 2 >= n / 2, so E <= 2 M - n <= n. Of the M - 1 steps from one agreeing word to the next at most E / 2 hold two edits or
more, so M - 1 - E / 2 >= n / 2 - 1 steps are seeds, at as many of the item's n - 1 first words. Any n // 2 + 1 first
words hold one of them: those whose pairs are in the fewest documents (counted over the whole corpus) are taken.

Cases: words are runs of ASCII letters and digits and of other characters than ASCII, lower-cased; items without a
word and documents without a seed match nothing; an item of under three words is one seed and must stand there whole, with at most one word between; null ids pass through;
repeated rows give repeated pairs; no item is too common to match.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .words import _PRIME, U, batches, hash_words, mix, texts_of

BLOCK_BYTES = 4 << 20
CUT = 0.5
_b = np.arange(256)
#: Bytes between words.
GAP = ~(((_b >= 48) & (_b <= 57)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128))


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return hash_words([x.lower() for x in blobs], GAP)


def align(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair: all pairs advance together, one word of a at a time."""
    rows, width = max(map(len, a)), max(map(len, b))
    x, y = np.zeros((len(a), rows), U), np.ones((len(b), width), U)
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x[i, : len(p)], y[i, : len(q)] = p, q
    slope = np.arange(width + 1, dtype=np.float32) / 2
    h = np.zeros((len(a), width + 1), np.float32)
    best = np.zeros(len(a), np.float32)
    for r in range(rows):
        t = h - np.float32(0.5)
        np.maximum(t[:, 1:], h[:, :-1] + np.where(x[:, r : r + 1] == y, np.float32(1), np.float32(-0.5)), out=t[:, 1:])
        np.maximum(t, 0, out=t)
        h = np.maximum.accumulate(t + slope, axis=1) - slope
        np.maximum(best, h.max(axis=1), out=best)
    return best


def _pairs(h: np.ndarray, step: int) -> np.ndarray:
    """A hash of each word and the step-th after it; with step 0 of each word alone."""
    n = max(len(h) - step, 0)
    return mix(mix(h[:n]) * U(_PRIME) + h[step:]) if step else mix(h + U(1))


def _batches_of(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    for s, blobs in texts_of(batch):
        yield s, *word_hashes(blobs)


def _hits(h: np.ndarray, owner: np.ndarray, grams: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Word positions where one of the sorted grams starts, and the gram's number."""
    where, which = [], []
    for k in steps:
        if len(h) <= k:
            continue
        g = _pairs(h, k)
        at = np.searchsorted(grams, g)
        at[at == len(grams)] = 0
        hit = np.flatnonzero((grams[at] == g) & (owner[: len(g)] == owner[k:]))
        where.append(hit)
        which.append(at[hit])
    return (np.concatenate(where), np.concatenate(which)) if where else (np.zeros(0, np.int64),) * 2


def _document_counts(docs: DataFrame, grams: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """In how many documents each gram stands, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in it:
            for _, h, owner in _batches_of(batch):
                where, which = _hits(h, owner, shared.value, steps)
                pairs = np.unique(owner[where] * len(total) + which)
                total += np.bincount(pairs % len(total), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["g", "n"])

    counts = np.zeros(len(grams), np.int64)
    for g, n in docs.select("_text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n")).collect():  # one row a gram of the block
        counts[g] = n
    return counts


class Block:
    """Some items and their seeds."""

    def __init__(self, docs: DataFrame, rows: list):
        self.ids = [r[0] for r in rows]
        h, owner = word_hashes([(r[1] or "").encode() for r in rows])
        edge = np.searchsorted(owner, np.arange(len(rows) + 1))
        self.words = [h[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        grams = [[_pairs(w, k) for k in ((1, 2) if len(w) > 1 else (0,))] for w in self.words]
        self.steps = (0,) * any(len(w) == 1 for w in self.words) + (1, 2) * any(len(w) > 1 for w in self.words)
        self.grams = np.unique(np.concatenate([x for g in grams for x in g])) if grams else np.zeros(0, U)
        if not len(self.grams):
            return
        counts = _document_counts(docs, self.grams, self.steps)
        self.seeds = defaultdict(list)
        for item, g in enumerate(grams):
            numbers = [np.searchsorted(self.grams, x) for x in g]
            total = counts[numbers[0]]
            for x in numbers[1:]:
                total[: len(x)] += counts[x]
            for p in np.argsort(total, kind="stable")[: len(self.words[item]) // 2 + 1].tolist():
                for x in numbers:
                    if p < len(x) and counts[x[p]]:
                        self.seeds[int(x[p])].append((item, p))
        self.salts = mix(np.arange(1, len(rows) + 1, dtype=U))
        self.members = np.unique(np.concatenate([mix(np.unique(w) ^ s) for w, s in zip(self.words, self.salts, strict=True)]))

    def shared(self, h: np.ndarray, windows: list[tuple]) -> np.ndarray:
        """How many words of each window its item has."""
        size = np.array([x[3] - x[2] for x in windows])
        first = np.cumsum(size) - size
        words = h[np.arange(size.sum()) + np.repeat(np.array([x[2] for x in windows]) - first, size)]
        key = mix(words ^ np.repeat(self.salts[[x[1] for x in windows]], size))
        at = np.minimum(np.searchsorted(self.members, key), len(self.members) - 1)
        return np.add.reduceat((self.members[at] == key).astype(np.int64), first)

    def match(self, h: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(row, item, score, first word and word after the window) of pairs that reach the cut."""
        where, which = _hits(h, owner, self.grams, self.steps)
        begin = np.searchsorted(owner, np.arange(owner[-1] + 2)) if len(owner) else None
        found = defaultdict(list)
        for w, g in zip(where.tolist(), which.tolist(), strict=True):
            for item, p in self.seeds.get(g, ()):
                found[int(owner[w]), item].append((w - p, p))
        windows = []
        for (row, item), hits in found.items():
            n = len(self.words[item])
            slack = n + 1  # no more words than n are put in
            hits.sort()
            start = 0
            for i in range(1, len(hits) + 1):
                if i == len(hits) or hits[i][0] - hits[i - 1][0] > slack:
                    windows.append((row, item, max(hits[start][0] - slack, int(begin[row])), min(hits[i - 1][0] + n + slack, int(begin[row + 1]))))
                    start = i
        windows = [
            x for s in batches([x[3] - x[2] for x in windows], 1 << 20) for x, k in zip(windows[s], self.shared(h, windows[s]).tolist(), strict=True) if 2 * k >= len(self.words[x[1]])
        ]
        windows.sort(key=lambda x: (x[3] - x[2], len(self.words[x[1]])))
        best: dict[tuple[int, int], tuple] = {}
        for s in batches([(x[3] - x[2]) * 4 for x in windows], 1 << 20):
            part = windows[s]
            scores = align([self.words[x[1]] for x in part], [h[x[2] : x[3]] for x in part])
            for (row, item, a, b), score in zip(part, scores.tolist(), strict=True):
                score = min(score / len(self.words[item]), 1.0)
                if score >= CUT:
                    best[row, item] = max(best.get((row, item), (0,)), (score, a - int(begin[row]), b - int(begin[row])))
        return [(row, item, *x) for (row, item), x in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, item_id, score, first_word, end_word of every document that holds a copy of an item, edited or not."""
    return _found(docs, benchmark, text, doc_id).drop("_th")


def _found(docs: DataFrame, benchmark: DataFrame, text: str, doc_id: str) -> DataFrame:
    """As contaminated, with the text's hash (_th)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))
    kinds = (rows.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString())
    schema = f"doc_id {kinds[0]}, _th long, item_id {kinds[1]}, score double, first_word long, end_word long"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    items = benchmark.select("item_id", "text")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        block = Block(rows, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect())
        if not len(block.grams):
            continue
        shared = spark.sparkContext.broadcast(block)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in it:
                ids, hashes = batch.column("doc_id"), batch.column("_th")
                for s, h, owner in _batches_of(batch):
                    found = shared.value.match(h, owner)
                    place = pa.array([s.start + x[0] for x in found], pa.int64())
                    item = [shared.value.ids[x[1]] for x in found]
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": ids.take(place), "_th": hashes.take(place), "item_id": pa.array(item, item_type), "score": pa.array([x[2] for x in found], pa.float64())}
                        | {c: pa.array([x[i] for x in found], pa.int64()) for i, c in ((3, "first_word"), (4, "end_word"))}
                    )

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without those that hold a benchmark item. Rows with equal doc_id, or none, are judged by their own texts."""
    found = _found(docs, benchmark, text, doc_id).select(F.col("doc_id").alias("_leak"), F.col("_th").alias("_leak_th")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(text).alias("_th"))
    kept = rows.join(found, F.col(f"_row.`{doc_id}`").eqNullSafe(F.col("_leak")) & (F.col("_th") == F.col("_leak_th")), "left_anti")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""Substring dedup: content-defined cuts by a gear hash find candidates, and every passage of over 50 words is held whole.

A window is MIN_WORDS (51) words that follow each other, taken as its bytes. Its cut is the word end, among those with a
whole CHUNK of words before them in the window, whose gear hash of the last 32 bytes is least (the first, if several are): it
depends on the window's bytes only, so all copies of a window are cut at the same word, and no text is without cuts. The
chunk is the CHUNK words before the cut. Windows whose chunk's digest stands in one document only can't be repeated; the
others are compared whole, by 80 bits of two hashes
and their number of bytes; neither hash is linear in the words, so that unequal windows agree by chance alone (1e12 windows: some 0.01 pairs).

A window in more than one document is repeated. Its holder is the first other document (least doc_id) that has it, or, in the
first document itself, the last. Repeated windows with one holder that overlap at one distance from the holder's text make a
span, so the holder has the whole span. Spans of one document may overlap where their holders differ.

Cases: null and empty texts and texts of 50 words or less have no spans; rows with equal doc_id and text are one document; a
window repeated within one document alone is not repeated; the first document of a window keeps it when spans are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, hot_limit, split_join
from .words import _PRIME, _SPACE, _SPACES, PIECE, U, batches, mix, sums, texts_of

MIN_WORDS = 51
#: Words of a chunk: with the bytes between them over 32, the bytes of a gear hash.
CHUNK = 17
SALTS = 1024
PAD = b"\n" * 32
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_GEAR[0] = 0


class Cut:
    """The words of some parts of texts, their windows and each window's cut. parts: row, bytes and words before it, and its bytes."""

    def __init__(self, parts: list[tuple[int, int, int, bytes]], min_words: int = MIN_WORDS):
        self.row, self.bytes_before, self.words_before = (np.array([x[i] for x in parts], np.int64) for i in range(3))
        blobs = [x[3] for x in parts]
        b = np.frombuffer(PAD + b"".join(x + PAD for x in blobs), np.uint8)
        gap = _SPACE[b]
        self.starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        self.ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        edge = len(PAD) + np.cumsum([0, *[len(x) + len(PAD) for x in blobs]])
        self.owner = np.searchsorted(edge, self.starts, side="right") - 1
        self.edge = edge
        self.levels = [self._level(b, lane) for lane in (0, 1)]
        h = _GEAR[b]
        for step in (1, 2, 4, 8, 16):  # the hash of 2 * step bytes from two of step bytes
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        n = max(len(self.starts) - min_words + 1, 0)
        self.windows = np.flatnonzero(self.owner[:n] == self.owner[len(self.owner) - n :])
        width, have = min_words - CHUNK + 1, 1
        least = h[self.ends - 1].astype(U) << U(32) | np.arange(len(self.ends), dtype=U)
        while have < width:  # the least of a window from those of two shorter ones
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        self.cuts = (least[self.windows + CHUNK - 1] & U(0xFFFFFFFF)).astype(np.int64)
        self.min_words = min_words

    def _level(self, b: np.ndarray, lane: int) -> list[np.ndarray]:
        """Hashes of the words; then of each word with the gap behind it, and of 2, 4, 8 of those that follow each other, as far as asked for."""
        total, step = sums(b, self.starts, lane), np.r_[self.starts[1:], len(b)][: len(self.starts)]
        one = lambda z: mix(total[z] - total[self.starts] + (z - self.starts).astype(U))
        return [one(self.ends), one(step)]

    def digest(self, first: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
        """Hash of the bytes from a word's start to the end of the word n - 1 further on."""
        level, out, at = self.levels[lane], np.full(len(first), n, U), first
        for k in range((n - 1).bit_length()):
            if len(level) < k + 2:
                half = 1 << (k - 1)
                level.append(mix(level[k][:-half] * U(_PRIME) + level[k][half:]))
            if (n - 1) >> k & 1:
                out = mix(out * U(_PRIME) + level[k + 1][at])
                at = at + (1 << k)
        return mix(out * U(_PRIME) + level[0][at]).view(np.int64)

    def place(self, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Bytes of the text before a place."""
        owner = self.owner[word]
        return (at - self.edge[owner] + self.bytes_before[owner]).astype(np.int32)

    def number(self, word: np.ndarray) -> np.ndarray:
        """Words of the text before a word."""
        owner = self.owner[word]
        return word - np.searchsorted(self.owner, owner) + self.words_before[owner]


def _overlapping(blob: bytes, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """A long text in parts that share min_words - 1 words, so each window is whole in one of them: bytes and words before it, its bytes."""
    at = words = 0
    size = PIECE
    while len(blob) - at > size and (end := _SPACES.search(blob, at + size)):
        starts = [m.start() for m in _WORD.finditer(blob, at, end.start())]
        if len(starts) < 2 * min_words:  # very long words
            size *= 2
            continue
        yield at, words, blob[at : end.start()]
        at, words, size = starts[1 - min_words], words + len(starts) - min_words + 1, PIECE
    yield at, words, blob[at:]


def _parts(batch: pa.RecordBatch, min_words: int) -> Iterator[Cut]:
    for s, blobs in texts_of(batch):
        parts = [(s.start + i, *x) for i, blob in enumerate(blobs) for x in _overlapping(blob, min_words)]
        for t in batches([len(x[3]) for x in parts]):
            cut = Cut(parts[t], min_words)
            if len(cut.windows):
                yield cut


def _same_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """left and the columns that right has besides, for rows with equal _row and _id (null ids are equal)."""
    right = right.select(F.col("_id").alias("_id2"), F.col("_row").alias("_row2"), *[c for c in right.columns if c not in ("_id", "_row")])
    return left.join(right, (F.col("_row") == F.col("_row2")) & F.col("_id").eqNullSafe(F.col("_id2"))).drop("_id2", "_row2")


def _numbered(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """rows (_id, _row) with _doc, their rank by _id and _row: sorted in range parts, whose totals are summed up; and how many they are."""
    placed = rows.orderBy("_id", "_row").select("_id", "_row", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    placed = scratch.save(placed, "numbers")
    before, total = [], 0
    for part, n in sorted(tuple(r) for r in placed.groupBy("_part").count().collect()):  # one row a part
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    return placed.join(F.broadcast(offsets), "_part").select("_id", "_row", (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("_doc")), total


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start_byte, end_byte, n_words, n_windows, first_doc_id, other_doc_id, _row, _kept of every span: first_doc_id has
    all its windows first, other_doc_id is another document's that has the span whole; _kept if the document is the first."""
    scratch = Scratch(docs.sparkSession)
    if min_words <= CHUNK:
        raise ValueError(f"min_words must be over {CHUNK}")
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
    rows = rows.select("_id", F.xxhash64("_id", "_text").alias("_row"), "_text")
    kind = rows.schema["_id"].dataType.simpleString()

    def chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for cut in _parts(batch, min_words):
                last = np.unique(cut.cuts)
                take = pa.array(cut.row[cut.owner[last]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(take), batch.column("_row").take(take), pa.array(cut.digest(last - (CHUNK - 1), CHUNK)), pa.array(cut.place(cut.ends[last], last))],
                    ["_id", "_row", "_digest", "_cut"],
                )

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            docs, held = batch.column("_doc").to_numpy(), batch.column("_cuts")
            flat, size = held.flatten().to_numpy(), np.diff(held.offsets.to_numpy())
            hot = flat < 0
            held = np.repeat(np.arange(len(size)), size) << 32 | np.where(hot, -1 - flat, flat)
            for cut in _parts(batch, min_words):
                place = cut.row[cut.owner[cut.cuts]] << 32 | cut.place(cut.ends[cut.cuts], cut.cuts)
                hit = np.isin(place, held)
                first = cut.windows[hit]
                last = first + min_words - 1
                key = docs[cut.row[cut.owner[first]]] << bits | cut.place(cut.starts[first], first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cut.digest(first, min_words)), pa.array(cut.digest(first, min_words, 1).astype(np.int16)), pa.array(key, pa.int64()), pa.array((cut.ends[last] - cut.starts[first]).astype(np.int32)),
                        pa.array(cut.number(first).astype(np.int32)), pa.array(np.isin(place[hit], held[hot])),
                    ],
                    ["_window", "_check", "_key", "_size", "_no", "_hot"],
                )

    found = scratch.save(rows.mapInArrow(chunks, f"_id {kind}, _row long, _digest long, _cut int"), "chunks")
    common = found.groupBy("_digest").agg(F.min("_row").alias("_a"), F.max("_row").alias("_b"), F.count("*").alias("_n"))
    common = scratch.save(common.where("_a != _b").select("_digest", "_n"), "common")
    # a window stands no more often than its chunk: the cuts of hot chunks, and no others, can have hot windows; they are marked by their sign
    limit = hot_limit(common.agg(F.sum("_n")).first()[0] or 0)
    marked = F.when(F.col("_n") > limit, -1 - F.col("_cut")).otherwise(F.col("_cut"))
    held = split_join(found, common, ["_digest"], "_n").groupBy("_id", "_row").agg(F.collect_set(marked).alias("_cuts"))
    held = scratch.save(held, "held")
    scratch.drop("chunks", "common")
    numbers, total = _numbered(held.select("_id", "_row"), scratch)
    # a window's place is its document's number and its first byte in one long
    bits = (rows.agg(F.max(F.octet_length("_text"))).first()[0] or 1).bit_length()
    if total.bit_length() + bits > 63:
        raise ValueError(f"{total} documents with repeats, the longest text of up to 2**{bits} bytes: their places don't fit a long; take the table in parts")
    texts = _same_row(rows.select("_id", "_row", "_text"), _same_row(held, numbers))
    each = scratch.save(texts.select("_doc", "_text", "_cuts").mapInArrow(windows, "_window long, _check short, _key long, _size int, _no int, _hot boolean"), "windows")
    scratch.drop("held")
    doc = lambda c: F.shiftright(c, bits)
    # hot windows, few, get their first and last by broadcast, and their rows are dealt over SALTS tasks; the others' are dealt by window alone
    ends = [F.min("_key").alias("_low"), F.max("_key").alias("_high")]
    hot = each.where("_hot").groupBy("_window", "_check", "_size").agg(*ends, F.count("*").alias("_n")).where(F.col("_n") > limit).drop("_n")
    tagged = each.drop("_hot").join(F.broadcast(scratch.save(hot, "hot")), ["_window", "_check", "_size"], "left")
    tagged = tagged.withColumn("_salt", F.when(F.col("_low").isNull(), 0).otherwise(F.pmod(F.xxhash64("_key"), F.lit(SALTS))))
    same = Window.partitionBy("_window", "_check", "_size", "_salt")
    hits = tagged.withColumns({"_first": F.coalesce("_low", F.min("_key").over(same)), "_last": F.coalesce("_high", F.max("_key").over(same))}).where(doc("_first") != doc("_last"))
    holder = F.when(doc("_key") == doc("_first"), F.col("_last")).otherwise(F.col("_first"))
    start = F.col("_key").bitwiseAND((1 << bits) - 1)
    hits = hits.select(doc("_key").alias("_doc"), start.alias("_start"), "_size", "_no", (holder - F.col("_key")).alias("_far"))
    # the holder's number and place less the document's own: one distance is one holder
    line = Window.partitionBy("_doc", "_far").orderBy("_start")
    fresh = F.when(F.col("_no") - F.lag("_no").over(line) < min_words, 0).otherwise(1)
    spans = hits.withColumn("_fresh", fresh).withColumn("_span", F.sum("_fresh").over(line)).groupBy("_doc", "_far", "_span").agg(
        F.min("_start").cast("int").alias("start_byte"), F.max(F.col("_start") + F.col("_size")).cast("int").alias("end_byte"),
        (F.max("_no") - F.min("_no") + min_words).cast("long").alias("n_words"), F.countDistinct("_start").alias("n_windows"),
    )
    spans = spans.withColumn("_other", doc(F.col("_doc") * (1 << bits) + F.col("start_byte") + F.col("_far"))).withColumn("_kept", F.col("_other") > F.col("_doc"))
    names = lambda n, d, *more: numbers.select(F.col("_doc").alias(d), F.col("_id").alias(n), *more)
    spans = spans.join(names("doc_id", "_doc", "_row"), "_doc").join(names("other_doc_id", "_other"), "_other")
    first = F.when(F.col("_kept"), F.col("doc_id")).otherwise(F.col("other_doc_id")).alias("first_doc_id")
    return spans.select("doc_id", "start_byte", "end_byte", "n_words", "n_windows", first, "other_doc_id", "_row", "_kept")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the spans that a document before them (by doc_id) holds as well."""
    spans = repeated_spans(docs, min_words, text, doc_id).where("not _kept")
    gone = spans.groupBy(F.col("doc_id").alias("_id2"), F.col("_row").alias("_row2")).agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias("_gone"))
    rows = docs.select(F.struct("*").alias("_all"), F.xxhash64(F.col(doc_id), F.coalesce(text, F.lit(""))).alias("_row"))
    rows = rows.join(gone, (F.col("_row") == F.col("_row2")) & F.col(f"_all.`{doc_id}`").eqNullSafe(F.col("_id2")), "left")

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for x, gone in zip(texts, spans, strict=True):
            if gone is not None and x is not None:
                b, at, kept = x.encode(), 0, []
                for g in gone:
                    kept.append(b[at : g["start_byte"]])
                    at = max(at, g["end_byte"])
                x = b"".join([*kept, b[at:]]).decode("utf-8", "ignore")
            out.append(x)
        import pandas as pd

        return pd.Series(out, dtype=object)

    return rows.select(*[(cut(F.col(f"_all.`{c}`"), F.col("_gone")) if c == text else F.col(f"_all.`{c}`")).alias(c) for c in docs.columns])


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("_row", "_kept")

"""Document fingerprints from closed syncmers.

A k-mer of a text's code points is an anchor if the least of its s-mers stands at one of its ends. That depends on the
k-mer alone, so an edit moves or removes only the anchors that it touches. A fingerprint keeps, for each of BINS bins, the
least anchor hash that falls there, as four hex digits, or "----"; likeness is the share of the bins used by either text
that agree, an estimate of the overlap of the anchor sets.

Cases: a text shorter than k is one anchor, itself; null and empty texts have none and are alike with each other only;
equal texts have equal fingerprints; ties of doc_id in the order of documents fall by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, batches, chain, mix

K, S, BINS = 12, 5, 128
#: Code points that a task turns into arrays at a time, and bytes of text in a block.
PIECE, BLOCK_BYTES, MOST_BLOCKS = 1 << 18, 256 << 20, 4096
NONE = np.uint32(0xFFFFFFFF)


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of every anchor."""
    size = np.array([len(x) for x in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    edge = np.r_[0, np.cumsum(size)]
    inner = chain(points, S)
    width = K - S + 1
    n = len(points) - K + 1
    if n > 0:
        low = inner.copy()
        step = 1
        while step < width:  # sliding minimum over `width` s-mers, in doubling steps
            d = min(step, width - step)
            low[: len(low) - d] = np.minimum(low[: len(low) - d], low[d:])
            step += d
        low = low[:n]
        at = np.flatnonzero((inner[:n] == low) | (inner[width - 1 : width - 1 + n] == low))
        owner = np.searchsorted(edge, at, side="right") - 1
        keep = at + K <= edge[owner + 1]
        at, owner = at[keep], owner[keep]
        h = np.full(len(at), K, U)
        for j in range(K):
            h = mix(h * U(0x9E3779B97F4A7C15) + points[at + j])
    else:
        at, owner, h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    short = np.flatnonzero((size > 0) & (size < K))
    tiny = np.array([chain(points[edge[i] : edge[i + 1]], int(size[i]))[0] for i in short], U)
    return np.r_[owner, short], np.r_[at - edge[owner], np.zeros(len(short), np.int64)], np.r_[h, tiny]


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of BINS numbers below 2**16, or NONE, for each text. Long texts are taken in parts that share K - 1 code points."""
    parts = [(i, x[a : a + PIECE + K - 1]) for i, x in enumerate(texts) for a in range(0, max(len(x) - K + 1, 1), PIECE)]
    out = np.full((len(texts), BINS), np.iinfo(U).max, U)
    for s in batches([len(x) for _, x in parts], PIECE):
        owner, _, h = anchors([x for _, x in parts[s]])
        x = mix(h)
        row = np.array([i for i, _ in parts[s]], np.int64)[owner]
        np.minimum.at(out.reshape(-1), row * BINS + (x % U(BINS)).astype(np.int64), x >> U(8))
    return np.where(out == np.iinfo(U).max, NONE, (mix(out) >> U(48)).astype(np.uint32))


def render(rows: np.ndarray) -> list[str]:
    return ["".join("----" if v == NONE else f"{v:04x}" for v in row) for row in rows.tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    used = (a != NONE) | (b != NONE)
    n = used.sum(axis=1)
    return np.where(n > 0, (used & (a == b)).sum(axis=1) / np.maximum(n, 1), 1.0)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint of each whole text."""
    rest = [c for c in docs.columns if c != out]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s in batches(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist(), PIECE):
                part = batch.slice(s.start, s.stop - s.start)
                texts = [x or "" for x in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(render(fingerprints(texts)))], [*rest, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema), f"`{out}` string"])
    return docs.select(*rest).mapInArrow(run, schema)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, _text in blocks of falling doc_id, sorted in each block and followed by the next block's first row (_extra).

    Blocks are cut at quantiles of doc_id, a task each and MOST_BLOCKS at most, so texts are shuffled once; only each block's first
    doc_id comes to the driver.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id").where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2, min(size // BLOCK_BYTES, MOST_BLOCKS))
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks))))
    block = F.lit(len(cuts)) if not cuts else F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col("doc_id")))
    rows = docs.withColumn("_block", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(block).cast("int"))
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 62))), F.negative(F.xxhash64("_text")))
    firsts = rows.groupBy("_block").agg(F.max(order).alias("_first")).orderBy("_block").collect()  # a row a block
    if not firsts:
        return rows.withColumn("_extra", F.lit(False))
    names = [r["_block"] for r in firsts]
    goes_to = F.create_map(*[F.lit(x) for i, b in enumerate(names) for x in (b, names[i - 1])])
    first = spark.createDataFrame(firsts)
    heads = rows.join(F.broadcast(first), "_block").where(order == F.col("_first")).drop("_first").dropDuplicates(["_block"])
    tails = heads.withColumn("_block", goes_to[F.col("_block")]).withColumn("_extra", F.lit(True))
    return rows.withColumn("_extra", F.lit(False)).unionByName(tails).repartitionByRange(len(names), "_block").sortWithinPartitions("_block", "_extra", F.desc_nulls_last("doc_id"), F.xxhash64("_text"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for columns doc_id, text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))

    def pairs(items: list[tuple]) -> pa.RecordBatch:
        texts = [x[1] for x in items]
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for _, a, b in items]
        own, other, after = fingerprints(texts), fingerprints(edited), fingerprints([x[2] for x in items])
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([x[0] for x in items], pa.int64()), "n_chars": pa.array([len(x) for x in texts], pa.int64()),
            "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited], "fingerprint": render(own), "edited_fingerprint": render(other),
            "near_edited": likeness(own, other), "near_next": likeness(own, after),
        })

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, size, held = [], 0, None
        for whole in it:
            for s in batches(pc.binary_length(whole.column("_text")).to_pylist(), PIECE):
                batch = whole.slice(s.start, s.stop - s.start)
                for block, doc, text, extra in zip(*(batch.column(c).to_pylist() for c in ("_block", "doc_id", "_text", "_extra")), strict=True):
                    if held is not None and held[0] == block:
                        items.append((held[1], held[2], text))
                        size += len(held[2])
                        if size > PIECE:
                            yield pairs(items)
                            items, size = [], 0
                    held = None if extra else (block, doc, text)
        if items:
            yield pairs(items)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(rows).select("_block", "doc_id", "_text", "_extra").mapInArrow(run, schema)


def op2_syncmers(spark, sf_dir: str) -> DataFrame:
    return edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

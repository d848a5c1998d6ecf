"""Vector code compression: product codes over integer codebooks, found in blocks along a Hilbert curve.

Vectors become integers floor(4096 x) and are cut into PARTS equal parts. Each part position's subvectors are range-partitioned and sorted along a
Hilbert curve and packed into flat blocks with the least box around them and their sums. In a round, distances between a block's box and the codebook
give the block's shortlist: an entry farther from the whole box than another is at most can be nearest to none of its points. One entry left takes the
block's count and sums without a look at its points; else a small integer kernel measures points against the shortlist. All arithmetic is exact, so
codes and codebooks depend neither on blocks nor on how rows are dealt.

A round returns a row for each (part, entry, component) from each task, summed by Spark; the driver holds the codebooks alone (PARTS * ENTRIES vectors).
Equal vectors are neighbours on the curve and are dealt by row after that, so a vector that is a third of all rows fills many blocks, each of
which a shortlist of one settles.

Components of 2**27 and more after scaling (2**23 in vectors of over 512 components) would overflow 64 bits; such subvectors are kept as doubles and
measured with Python's integers, in blocks of their own kind.

Cases: rows whose vector is null or holds null, NaN or infinite components are dropped; the codebook of a table with fewer than ENTRIES vectors has
fewer entries; of equal vec_ids the lesser vector comes first in the initial codebook, null ids come last; repeated rows stay; a vector whose length isn't
that of the first usable one (by vec_id; its length a multiple of PARTS) stays with null code and error; an error beyond a long is null; sums by label
take the errors that aren't null; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, split_join

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK = 128
#: Bits of a place on the curve, and components that it looks at.
CURVE_BITS, CURVE_DIMS = 56, 28
#: Bits of the pieces in which sums travel.
LIMB = 40


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows of integers below 2**bits)."""
    x = x.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def whole(x: float) -> int:
    """floor(SCALE * x), exactly, of any finite double."""
    return floor(x * SCALE) if abs(x) < 2.0**1000 else int(x) * SCALE


def _limit(d: int) -> int:
    return 1 << (27 if d <= 64 else 23)


def _subvectors(width: int, spread: float):
    """Arrow function: vectors in, a row for each part out (key: part and place on the curve; row; vec_id and label with part 0 alone; points)."""
    d = width // PARTS
    dims = min(d, CURVE_DIMS)
    bits = max(2, min(7, CURVE_BITS // dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, width)
            rows = pa.array(np.arange(row, row + n, dtype=np.int64))
            row += n
            with np.errstate(over="ignore"):
                scaled = np.floor(x * SCALE)
                grid = np.clip(((x / spread) + 1) * (1 << (bits - 1)), 0, (1 << bits) - 1).astype(np.int64)
            for p in range(PARTS):
                part = slice(p * d, (p + 1) * d)
                place = hilbert(grid[:, p * d : p * d + dims], bits) | (p << CURVE_BITS)
                most = np.abs(scaled[:, part]).max(axis=1)
                cells = [None] * n
                for least, limit, raw in ((-1, 1 << 15, scaled.astype("<i2", casting="unsafe")), (1 << 15, _limit(d), scaled.astype("<i4", casting="unsafe")), (_limit(d), np.inf, x)):
                    for i in np.flatnonzero((most >= least) & ((most < limit) | (limit == np.inf))).tolist():
                        cells[i] = raw[i, part].tobytes()
                names = [batch.column(c) if p == 0 else pa.nulls(n, batch.schema.field(c).type) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([pa.array(place), rows, *names, pa.array(cells, pa.binary())], ["key", "row", "vec_id", "label", "points"])

    return run


def _points(size: int, raw: bytes, d: int) -> np.ndarray:
    """A block's points: 64-bit integers, or Python's where the components are doubles."""
    if size < 8:
        return np.frombuffer(raw, f"<i{size}").reshape(-1, d).astype(np.int64)
    return np.array([whole(v) for v in np.frombuffer(raw, float).tolist()], object).reshape(-1, d)


def _blocks(d: int):
    """Arrow function: sorted subvectors in, blocks out (box: least and greatest components and sums; null for doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind, schema, out = [], None, None, []

        def close() -> None:
            key, size = kind
            raw = b"".join(h[3] for h in held)
            box = None
            if size < 8:
                pts = _points(size, raw, d)
                box = np.concatenate([pts.min(axis=0), pts.max(axis=0), pts.sum(axis=0)]).tolist()
            ids = ([h[1] for h in held], [h[2] for h in held]) if key == 0 else ([], [])
            out.append((key, size, [h[0] for h in held], *ids, raw, box))

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            if schema is None:
                ids = [(c + "s", pa.list_(batch.schema.field(c).type)) for c in ("row", "vec_id", "label")]
                schema = pa.schema([("part", pa.int32()), ("size", pa.int32()), *ids, ("points", pa.binary()), ("box", pa.list_(pa.int64()))])
            for key, *rest in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "vec_id", "label", "points")), strict=True):
                now = (key >> CURVE_BITS, len(rest[3]) // d)
                if held and (now != kind or len(held) == BLOCK):
                    close()
                    held = []
                kind = now
                held.append(rest)
            if len(out) >= 256:
                yield flush()
                out = []
        if held:
            close()
        if out:
            yield flush()

    return run


class Books:
    """Codebooks: for each part a list of entries, each a list of integers."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries, self.d = entries, len(entries[0][0])
        self.limit = _limit(self.d)
        self.wide = [[any(abs(v) >= self.limit for v in e) for e in part] for part in entries]
        self.exact = [np.array(part, object).reshape(len(part), -1) for part in entries]
        self.fast = [None if any(w) else e.astype(np.int64) for w, e in zip(self.wide, self.exact, strict=True)]

    def shortlist(self, part: int, box: list[int] | None) -> np.ndarray:
        """Entries, ascending, of which each point in the box has its nearest and all that are as near."""
        e = self.fast[part]
        if box is None or e is None:
            if box is None:
                return np.arange(len(self.exact[part]))
            e = self.exact[part]
        lo, hi = (np.array(box[i * self.d : (i + 1) * self.d], e.dtype) for i in (0, 1))
        below, above = lo - e, e - hi
        near = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(np.abs(below), np.abs(above))
        return np.flatnonzero(((near * near).sum(axis=1) <= (far * far).sum(axis=1).min()).astype(bool))

    def nearest(self, part: int, chosen: np.ndarray, pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's nearest entry among the chosen, ties to the lower, and the squared distance."""
        fast = pts.dtype != object and not any(self.wide[part][i] for i in chosen)
        e = self.exact[part][chosen].astype(np.int64) if fast else self.exact[part][chosen]
        best, at = None, np.zeros(len(pts), np.int64)
        for k, entry in zip(chosen.tolist(), e, strict=True):
            gap = pts - entry
            dist = (gap * gap).sum(axis=1)
            if best is None:
                best, at = dist, np.full(len(pts), k, np.int64)
            else:
                less = (dist < best).astype(bool)
                best, at = np.where(less, dist, best), np.where(less, k, at)
        return at, best

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for e in part for v in e).encode()).hexdigest()


SUMS = "part int, entry int, component int, limb int, value long"


def _gather(books: Books):
    """Arrow function: blocks in, counts (component -1) and sums of each entry's points out, one row for each LIMB bits of a sum."""
    d = books.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (PARTS, max(map(len, books.entries)), d + 1)
        total, big = np.zeros(shape, np.int64), {}
        for batch in batches:
            for part, size, points, box in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "points", "box")), strict=True):
                chosen = books.shortlist(part, box)
                if len(chosen) == 1 and box is not None:
                    total[part, chosen[0]] += np.array([*box[2 * d :], len(points) // (size * d)])
                    continue
                pts = _points(size, points, d)
                at, _ = books.nearest(part, chosen, pts)
                for k in np.unique(at).tolist():
                    mine = pts[at == k]
                    total[part, k, d] += len(mine)
                    if size < 8:
                        total[part, k, :d] += mine.sum(axis=0)
                    else:
                        big[part, k] = mine.sum(axis=0) + big.get((part, k), 0)
        out = []
        for part, k in np.argwhere(total[:, :, d] > 0).tolist():
            more = big.get((part, k), [0] * d)
            out.append((part, k, -1, 0, int(total[part, k, d])))
            for j in range(d):
                value, limb = int(total[part, k, j]) + more[j], 0
                while not -(1 << LIMB) <= value < 1 << LIMB:
                    out.append((part, k, j, limb, value & ((1 << LIMB) - 1)))
                    value, limb = value >> LIMB, limb + 1
                out.append((part, k, j, limb, value))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32()] * 4 + [pa.int64()], strict=True)], [x.split()[0] for x in SUMS.split(", ")])

    return run


def _emit(books: Books):
    """Arrow function: blocks in, a row for each subvector out (row, its entry shifted to the part's byte, error; vec_id and label with part 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(c).type.value_type for c in ("vec_ids", "labels")]
            columns = [batch.column(c).to_pylist() for c in ("part", "size", "points", "box", "rows", "vec_ids", "labels")]
            for part, size, points, box, rows, ids, labels in zip(*columns, strict=True):
                at, error = books.nearest(part, books.shortlist(part, box), _points(size, points, books.d))
                errors = [int(v) if v < 1 << 63 else None for v in error.tolist()]
                named = [pa.array(v, t) if part == 0 else pa.nulls(len(rows), t) for v, t in zip((ids, labels), types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(at << (8 * (PARTS - 1 - part))), pa.array(errors, pa.int64()), *named], ["row", "code", "error", "vec_id", "label"]
                )

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) of the rows whose vector has finite components only."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", "label", v.alias("embedding"))


def compress(vectors: DataFrame) -> tuple[DataFrame, Books | None]:
    """vec_id, label, code (two hex digits a part), error of every usable row, and the codebooks (None without a usable row)."""
    scratch = Scratch(vectors.sparkSession)
    kept = usable(vectors)
    fits = kept.where((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    by_id = (F.col("vec_id").isNull(), F.col("vec_id"), F.col("embedding"))
    first = fits.orderBy(*by_id).limit(1).collect()
    none = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not first:
        return none, None
    width = len(first[0].embedding)
    d = width // PARTS
    fits = fits.where(F.size("embedding") == width)
    seeds = [r.embedding for r in fits.orderBy(*by_id).limit(ENTRIES).collect()]
    books = Books([[[whole(v) for v in s[p * d : (p + 1) * d]] for s in seeds] for p in range(PARTS)])

    # the curve's grid spans three times the mean size of a component; this bears on the boxes only, not on results
    mean = fits.agg(F.avg(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x) / width))).first()[0]
    spread = 3 * mean if mean and 1e-300 < mean < 1e300 else 1.0
    vec, lab = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    parts = fits.mapInArrow(_subvectors(width, spread), f"key long, row long, vec_id {vec}, label {lab}, points binary")
    ordered = parts.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    blocks = ordered.mapInArrow(_blocks(d), f"part int, size int, rows array<long>, vec_ids array<{vec}>, labels array<{lab}>, points binary, box array<long>")
    blocks = scratch.save(blocks, "blocks")

    for _ in range(ROUNDS):
        sums = blocks.select("part", "size", "points", "box").mapInArrow(_gather(books), SUMS)
        books = _moved(books, sums.groupBy("part", "entry", "component", "limb").agg(F.sum("value").alias("value")).collect())

    each = blocks.mapInArrow(_emit(books), f"row long, code long, error long, vec_id {vec}, label {lab}")
    coded = each.groupBy("row").agg(
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.lower(F.lpad(F.hex(F.sum("code")), 2 * PARTS, "0")).alias("code"),
        F.when(F.count("error") == PARTS, F.try_sum("error")).alias("error"),
    )
    return coded.drop("row").unionByName(none.where(~F.size("embedding").eqNullSafe(width))), books


def _moved(books: Books, rows: list) -> Books:
    """The codebooks after a round: entries with points become the floors of their means."""
    count, total = {}, {}
    for r in rows:
        at = (r.part, r.entry)
        if r.component < 0:
            count[at] = r.value
        else:
            total.setdefault(at, [0] * books.d)[r.component] += r.value << (LIMB * r.limb)
    return Books([[[v // count[p, k] for v in total[p, k]] if (p, k) in count else e for k, e in enumerate(part)] for p, part in enumerate(books.entries)])


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    scratch = Scratch(spark)
    key = [F.col("label").isNull().alias("_null"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")]
    coded = scratch.save(coded, "coded").select("*", *key)
    sums = coded.groupBy("_null", "_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n"))
    out = split_join(coded, scratch.save(sums, "sums"), ["_null", "_label"], "_n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def _sql_rounds() -> str:
    out = []
    for r in range(ROUNDS + 1):
        # struct order: distance, then entry
        out.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, p, min(struct_pack(dist := dist, entry := entry)) AS best FROM (
    SELECT s.vec_id, s.p, b.entry, list_sum(list_transform(list_zip(s.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
    FROM parts s JOIN book{r} b ON s.p = b.p) GROUP BY vec_id, p)""")
        if r < ROUNDS:
            out.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
    SELECT p, entry, list(t // n - CASE WHEN t % n < 0 THEN 1 ELSE 0 END ORDER BY j) AS v FROM (
      SELECT s.p, near{r}.best.entry AS entry, j, CAST(sum(s.v[j]) AS BIGINT) AS t, count(*) AS n
      FROM parts s JOIN near{r} USING (vec_id, p), unnest(range(1, CAST(len(s.v) + 1 AS BIGINT))) AS js(j) GROUP BY ALL) GROUP BY p, entry) m USING (p, entry))""")
    return ",\n".join(out)


OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM kept, unnest(range({PARTS})) AS ps(p)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
book0 AS (SELECT p, entry, v FROM parts JOIN seeds USING (vec_id)),
{_sql_rounds()},
coded AS (
  SELECT vec_id, string_agg(lower(lpad(printf('%x', best.entry), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best.dist) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id),
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN (SELECT vec_id, label FROM kept) USING (vec_id), sha
"""

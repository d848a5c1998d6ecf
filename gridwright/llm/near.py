"""Near-duplicate documents: SuperMinHash signatures, bands, exact verification and union-find groups.

1. Each text becomes a set of word shingles, a 128-bit key of that set, and a SuperMinHash signature. Equal sets are one
   class from here on, so copies cost one row each.
2. Bands of the signature put classes in buckets; classes that share a bucket, directly or through others, make a
   *cluster* (connected components over one link from each member to its bucket's least class).
3. Clusters fetch their sets. Within one, pairs whose signatures come near the threshold are compared on the full sets,
   best first, and only if union-find has not joined them already: what comes out is a spanning forest, never all pairs.
   A cluster above CLUSTER_BYTES is dealt into blocks: first each block by itself together with the cluster's most central
   members, then what is still outside the cluster's largest component, in blocks, against all blocks.
4. Connected components of those links are the groups.

The bands miss a link at the threshold with a probability below 1e-6; nothing is capped.

Cases: A-Z only are lower-cased; words are runs without ASCII white space; a text with fewer than k words has one shingle,
all its words; a null, empty or blank text has none and is linked with nothing; rows with equal doc_id are rows
like others; a null doc_id is never a group's name unless all its members are null, and then each of them is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, split_join
from .words import U, batches, mix, shingles, texts_of

HASHES = 120
CLUSTER_BYTES = 8 << 20
PIVOTS = 8


def choose_rows(threshold: float, hashes: int = HASHES, miss: float = 1e-6) -> int:
    """The most rows a band that still miss a pair at the threshold with a probability below `miss`."""
    return max(r for r in range(1, 16) if (1 - threshold**r) ** (hashes // r) < miss or r == 1)


def superminhash(sets: list[np.ndarray], m: int = HASHES) -> np.ndarray:
    """A row of m values for each set, none of them empty.

    Element e draws in round j a fraction and the j-th place of its own permutation, and offers round + fraction there; a
    slot keeps its least offer. A set is done as soon as no slot holds more than the next round can offer.
    """
    if not sets:
        return np.zeros((0, m), U)
    sizes = np.array([len(x) for x in sets])
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    best = np.full((len(sets), m), np.iinfo(U).max, U)
    flat = best.reshape(-1)
    places = None
    for j in range(m):
        x = mix(elements + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at = j + (((x & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)
        if places is None:
            slot = at
        else:
            row = np.arange(len(elements))
            slot = places[row, at].astype(np.int64)
            places[row, at] = places[:, j]
        np.minimum.at(flat, owner * m + slot, (x >> U(32)) | U(j << 32))
        going = best.max(axis=1) >= U(j + 1 << 32)
        if not going.any():
            break
        more = going[owner]
        if places is None:
            places = np.tile(np.arange(m, dtype=np.uint8), (int(more.sum()), 1))
            places[np.arange(len(places)), at[more]] = 0
        else:
            places = places[more]
        elements, owner = elements[more], owner[more]
    return best


def short(signature: np.ndarray) -> np.ndarray:
    """16 bits of each value: equal values stay equal, others differ but for 1 in 65,536."""
    return (mix(signature) >> U(48)).astype(np.uint16)


def set_key(s: np.ndarray) -> bytes:
    """128 bits of a set: two sums over its elements, and its size in the first."""
    with np.errstate(over="ignore"):
        return np.array([mix(s ^ U(0x5BF03635)).sum(dtype=U) + U(len(s)), mix(s * U(0x9E3779B97F4A7C15) + U(7)).sum(dtype=U)]).tobytes()


def _describe(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s, blobs in texts_of(batch):
                sets = shingles([x.lower() for x in blobs], k)
                full = [i for i, x in enumerate(sets) if len(x)]
                signs = short(superminhash([sets[i] for i in full]))
                keys, sigs = [None] * len(sets), [None] * len(sets)
                for row, i in enumerate(full):
                    keys[i], sigs[i] = set_key(sets[i]), signs[row].tobytes()
                part = batch.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_th"), pa.array(keys, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(sigs, pa.binary())],
                    ["_id", "_th", "_key", "_n", "_sig"],
                )

    return run


def _bands(rows: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("_sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            n = HASHES // rows
            h = np.tile(np.arange(n, dtype=U), (len(sig), 1))
            for r in range(rows):
                h = mix(h * U(0x9E3779B97F4A7C15) + sig[:, r : n * rows : rows].astype(U))
            keys = batch.column("_key").take(pa.array(np.repeat(np.arange(len(sig)), n)))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), keys], ["_bucket", "_key"])

    return run


def _sets(k: int):
    """Rows of _text and _want: those whose set has the key _want, with the set; other columns pass through."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s, blobs in texts_of(batch):
                part = batch.slice(s.start, len(blobs))
                want = part.column("_key").to_pylist()
                sets = shingles([x.lower() for x in blobs], k)
                hit = [i for i, x in enumerate(sets) if len(x) and set_key(x) == want[i]]
                kept = part.take(pa.array(hit, pa.int64()))
                names = [c for c in part.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), pa.array([sets[i].tobytes() for i in hit], pa.binary())], [*names, "_set"])

    return run


def _links_of(group: list[tuple], num: int, den: int) -> Iterator[tuple[bytes, bytes]]:
    """Links between members (key, set, signature, component or None, part) of which one has part 0; a forest of them."""
    sets = [np.frombuffer(x[1], U) for x in group]
    sig = np.frombuffer(b"".join(x[2] for x in group), np.uint16).reshape(-1, HASHES)
    size = np.array([len(x) for x in sets])
    root = list(range(len(group)))
    known: dict[bytes, int] = {}
    for i, x in enumerate(group):
        if x[3] is not None:
            root[i] = known.setdefault(x[3], i)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    t = num / den
    least = (t - 5 * (t * (1 - t) / HASHES) ** 0.5) * HASHES
    inner = np.array([x[4] == 0 for x in group])
    for i in np.flatnonzero(inner).tolist():
        alike = (sig == sig[i]).sum(axis=1)
        near = (alike >= least) & (den * np.minimum(size, size[i]) >= num * np.maximum(size, size[i])) & ~(inner & (np.arange(len(group)) <= i))
        for j in sorted(np.flatnonzero(near).tolist(), key=lambda j: -alike[j]):
            a, b = find(i), find(j)
            if a == b:
                continue
            at = np.searchsorted(sets[j], sets[i])
            at[at == len(sets[j])] = 0
            both = int((sets[j][at] == sets[i]).sum())
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[max(a, b)] = min(a, b)
                yield group[i][0], group[j][0]


def _verify(num: int, den: int):
    """Rows sorted by _group: one group is in memory at a time."""
    names = ["_key", "_set", "_sig", "_comp", "_part"]

    def emit(group: list[tuple]) -> pa.RecordBatch:
        found = list(_links_of(group, num, den))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["_a", "_b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None
        for whole in it:
            for s in batches(pc.binary_length(whole.column("_set")).to_pylist()):
                batch = whole.slice(s.start, s.stop - s.start)
                for g, *row in zip(batch.column("_group").to_pylist(), *(batch.column(c).to_pylist() for c in names), strict=True):
                    if g != at and group:
                        yield emit(group)
                        group = []
                    at = g
                    group.append(tuple(row))
        if group:
            yield emit(group)

    return run


def _verified(rows: DataFrame, num: int, den: int) -> DataFrame:
    dealt = rows.repartition("_group").sortWithinPartitions("_group")
    return dealt.select("_group", "_key", "_set", "_sig", "_comp", "_part").mapInArrow(_verify(num, den), "_a binary, _b binary")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row: groups of texts linked by den * |a & b| >= num * |a | b|."""
    return _grouped(docs, k, num, den, text, doc_id).select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_id").eqNullSafe(F.col("_component")).alias("kept")
    )


def _grouped(docs: DataFrame, k: int, num: int, den: int, text: str, doc_id: str) -> DataFrame:
    """_id, _th (the text's hash), _n, _component, _root (the group; null without words) for each row."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    base = scratch.save(rows.mapInArrow(_describe(k), f"_id {kind}, _th long, _key binary, _n long, _sig binary"), "described")
    classes = base.where("_n > 0").groupBy("_key").agg(
        F.min("_id").alias("_low"), F.min(F.struct("_id", "_th")).alias("_rep"), F.min("_sig").alias("_sig"), F.max("_n").alias("_n"), F.count("*").alias("_copies")
    )
    classes = scratch.save(classes, "classes")

    member = scratch.save(classes.select("_key", "_sig").mapInArrow(_bands(choose_rows(num / den)), "_bucket long, _key binary"), "members")
    buckets = member.groupBy("_bucket").agg(F.min("_key").alias("_hub"), F.count("*").alias("_size")).where("_size > 1")
    buckets = scratch.save(buckets, "buckets")
    shared = split_join(member, buckets, ["_bucket"], "_size").groupBy("_key", "_hub").agg(F.sum("_size").alias("_degree"))
    shared = scratch.save(shared, "shared")
    scratch.drop("members", "buckets")
    trees = connected_components(shared.select(F.col("_key").alias("_a"), F.col("_hub").alias("_b")), scratch, "cluster")
    cluster = trees.select(F.col("_a").alias("_key"), F.col("_b").alias("_top")).unionByName(trees.select(F.col("_b").alias("_key"), F.col("_b").alias("_top")).distinct())

    degree = shared.groupBy("_key").agg(F.sum("_degree").alias("_degree"))
    wanted = cluster.join(classes, "_key").join(degree, "_key", "left").select("_key", "_top", "_sig", "_degree", F.col("_rep._id").alias("_rid"), F.col("_rep._th").alias("_rth"))
    fetched = rows.join(wanted, rows["_id"].eqNullSafe(wanted["_rid"]) & (rows["_th"] == wanted["_rth"])).select("_text", "_key", "_top", "_sig", "_degree")
    sets = scratch.save(fetched.mapInArrow(_sets(k), "_key binary, _top binary, _sig binary, _degree long, _set binary").dropDuplicates(["_key"]), "sets")
    weight = sets.groupBy("_top").agg(F.sum(F.octet_length("_set") + 4 * HASHES).alias("_bytes"))
    weight = scratch.save(weight.withColumn("_blocks", F.ceil(F.col("_bytes") / CLUSTER_BYTES).cast("int")), "weight")

    none, zero = F.lit(None).cast("binary").alias("_comp"), F.lit(0).alias("_part")
    big_tops = weight.where("_blocks > 1").select("_top", "_blocks", "_bytes")  # few: all sets' bytes / CLUSTER_BYTES at most
    has_big = bool(big_tops.take(1))
    small = sets.join(weight.where("_blocks > 1"), "_top", "left_anti") if has_big else sets
    links = _verified(small.select(F.col("_top").alias("_group"), "_key", "_set", "_sig", none, zero), num, den)
    if has_big:
        links = links.unionByName(_big_clusters(sets, big_tops, num, den, scratch))
    trees = connected_components(links, scratch, "group")

    names = classes.join(trees.select(F.col("_a").alias("_key"), F.col("_b").alias("_root")), "_key", "left").withColumn("_root", F.coalesce("_root", "_key"))
    lowest = names.groupBy("_root").agg(F.min("_low").alias("_component"), F.count("*").alias("_members"))
    named = split_join(names.select("_key", "_root", "_copies"), lowest, ["_root"], "_members").select("_key", "_root", "_component", "_copies")
    named = scratch.save(named, "named")
    scratch.drop("sets", "weight", "shared")
    full = split_join(base.where("_n > 0").select("_id", "_th", "_key", "_n"), named, ["_key"], "_copies").select("_id", "_th", "_n", "_component", "_root")
    none = F.lit(None).cast("binary").alias("_root")
    return full.unionByName(base.where("_n = 0").select("_id", "_th", "_n", F.col("_id").alias("_component"), none))


def _big_clusters(sets: DataFrame, big: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links of the clusters that are too large for one task."""
    dealt = sets.join(big, "_top").withColumn("_block", F.pmod(F.xxhash64("_key"), F.col("_blocks")).cast("int"))
    dealt = scratch.save(dealt, "dealt")
    # a cluster's most central members, by how many members its buckets have
    best = F.slice(F.sort_array(F.collect_list("_c"), asc=False), 1, PIVOTS)
    central = dealt.groupBy("_top", "_block").agg(F.max(F.struct("_degree", "_key")).alias("_c")).groupBy("_top").agg(best.alias("_best"))
    central = central.select("_top", F.explode("_best._key").alias("_key"))
    pivots = dealt.join(central, ["_top", "_key"]).withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).where("_at != _block")
    none = F.lit(None).cast("binary").alias("_comp")
    group = lambda block, *more: F.concat(F.col("_top"), *[F.encode(F.format_string("/%d", c), "utf-8") for c in (block, *more)]).alias("_group")
    own = dealt.select(group(F.col("_block")), "_key", "_set", "_sig", none, F.lit(0).alias("_part"))
    first = own.unionByName(pivots.select(group(F.col("_at")), "_key", "_set", "_sig", none, F.lit(1).alias("_part")))
    first = scratch.save(_verified(first, num, den), "first")

    trees = connected_components(first, scratch, "inner")
    comp = dealt.select("_top", "_key").join(trees.select(F.col("_a").alias("_key"), F.col("_b").alias("_comp")), "_key", "left").withColumn("_comp", F.coalesce("_comp", "_key"))
    comp = scratch.save(comp, "comp")
    largest = comp.groupBy("_top", "_comp").count().groupBy("_top").agg(F.max_by("_comp", F.struct("count", "_comp")).alias("_main"))
    known = dealt.join(comp, ["_top", "_key"]).join(largest, "_top")
    outside = known.where(F.col("_comp") != F.col("_main"))
    room = outside.groupBy("_top").agg(F.ceil(F.sum(F.octet_length("_set") + 4 * HASHES) / CLUSTER_BYTES).cast("int").alias("_rooms"))
    outside = outside.join(room, "_top").withColumn("_room", F.pmod(F.xxhash64("_key", F.lit(1)), F.col("_rooms")).cast("int"))
    left = outside.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    right = known.join(room, "_top").withColumn("_room", F.explode(F.sequence(F.lit(0), F.col("_rooms") - 1)))
    pick = lambda df, at, part: df.select(group(F.col("_room"), F.col(at)), "_key", "_set", "_sig", "_comp", F.lit(part).alias("_part"))
    rest = pick(left, "_at", 0).unionByName(pick(right, "_block", 1))
    return first.unionByName(scratch.save(_verified(rest, num, den), "rest"))


def dedup_near(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document of each group, the one with the least doc_id. Rows without a word, and those whose group has
    null doc_ids only, all stay; of rows with equal doc_id in a group one stays."""
    free = F.col("_id").isNull() | (F.col("_n") == 0)
    kept = _grouped(docs, k, num, den, text, doc_id).where(F.col("_id").eqNullSafe(F.col("_component")))
    kept = kept.groupBy("_id", "_root", F.when(free, F.col("_th")).alias("_own")).agg(F.min("_th").alias("_kept_th"))
    verdict = kept.select(F.col("_id").alias("_kept_id"), "_kept_th", F.col("_own").isNotNull().alias("_free"))
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_th"))
    one = rows.join(verdict, F.col(f"_row.`{doc_id}`").eqNullSafe(F.col("_kept_id")) & (F.col("_th") == F.col("_kept_th")))
    single, rest = one.where("not _free").dropDuplicates(["_kept_id", "_kept_th"]), one.where("_free")
    return single.unionByName(rest).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, k=3, num=85, den=100)

"""Line dedup, with DataFrame functions alone.

Every line's key is hashed; hashes are range-partitioned and sorted by document and position, so each key's
occurrences stream past once. What comes back is a sparse bitmap of lines for each document, never text. Hot keys
(shared.hot_limit: few, however large the table) don't go through the range partitions: their document counts are summed in
two steps and broadcast.

Cases: a null or empty text is one empty line; a null doc_id is a document like others; rows with equal doc_id and
equal text are one document and get the same bitmap; empty keys (blank lines) are never dropped; further columns
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, hot_limit

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_BITS = 32
LEAST_HOT = 1000


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case and nothing else. lower() does the same, faster, where every character is one byte."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_occurrences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """_h1, _h2 (128 bits of the key's hash), _doc, _text, _pos of every line whose key isn't empty."""
    lines = docs.select(
        F.col(doc_id).alias("_doc"), _text_id(F.col(text)).alias("_text"), F.posexplode(split_lines(F.col(text))).alias("_pos", "_line")
    ).withColumn("_key", line_key(F.col("_line")))
    return lines.where(F.length("_key") > 0).select(
        F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("_h2"), "_doc", "_text", "_pos"
    )


def drop_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """_doc, _text and _drop, a map from word number to the bits of the lines to drop, for documents that lose any.

    Keys in at least min_docs documents lose all their lines, or with keep_first all but the first by document and
    position.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(line_occurrences(docs, text, doc_id), "occurrences")
    key, place = ["_h1", "_h2"], ["_doc", "_text", "_pos"]

    counts = found.groupBy(*key).count()
    limit = hot_limit(found.count(), LEAST_HOT)  # Parquet's own row counts
    hot = scratch.save(counts.where(F.col("count") > limit).select(*key), "hot")

    # the rest: range partitions of the hash, sorted by document and position
    stream = Window.partitionBy(*key).orderBy("_doc", "_text")
    cool = (
        found.join(F.broadcast(hot), key, "left_anti")
        .repartitionByRange(*key)
        .sortWithinPartitions(*key, *place)
        .withColumn("_nth", F.dense_rank().over(stream))
        .withColumn("_docs", F.max("_nth").over(Window.partitionBy(*key)))
        .where(F.col("_docs") >= min_docs)
    )
    hot_rows = found.join(F.broadcast(hot), key, "left_semi")
    hot_docs = hot_rows.groupBy(*key, "_doc", "_text").agg(F.min("_pos").alias("_pos")).groupBy(*key)
    hot_docs = hot_docs.agg(F.count("*").alias("_docs"), F.min(F.struct(*place)).alias("_first")).where(F.col("_docs") >= min_docs)
    hot_rows = found.join(F.broadcast(hot_docs), key, "inner")
    if keep_first:
        cool = cool.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*place))).where("_row > 1")
        hot_rows = hot_rows.where(~F.struct(*place).eqNullSafe(F.col("_first")))
    return (
        cool.select(*place).unionByName(hot_rows.select(*place))
        .groupBy("_doc", "_text", F.floor(F.col("_pos") / WORD_BITS).cast("int").alias("_word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_pos") % WORD_BITS)).alias("_bits"))
        .groupBy("_doc", "_text")
        .agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_drop"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs as struct _row, with _lines (array), _kept (array of the lines that stay)."""
    rows = docs.select(F.struct("*").alias("_row"), _text_id(F.col(text)).alias("_t"))
    joined = rows.join(bitmaps, F.col(f"_row.`{doc_id}`").eqNullSafe(F.col("_doc")) & (F.col("_t") == F.col("_text")), "left")

    def stays(_: Column, i: Column) -> Column:
        word = F.element_at("_drop", F.floor(i / WORD_BITS).cast("int"))
        return F.coalesce(F.call_function("getbit", word, i % WORD_BITS) == 0, F.lit(True))

    lines = joined.select("_row", "_drop", split_lines(F.col(f"_row.`{text}`")).alias("_lines"))
    return lines.select("_row", "_lines", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", stays)).alias("_kept"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """docs with the text's repeated lines dropped; other columns unchanged. A null text stays null."""
    out = apply_bitmaps(docs, drop_bitmaps(docs, text, doc_id, min_docs, keep_first), text, doc_id)
    kept = F.when(F.col(f"_row.`{text}`").isNotNull(), F.array_join("_kept", "\n"))
    return out.select(*[(kept if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_bitmaps(docs, drop_bitmaps(docs, min_docs=10))
    n = F.size("_lines").cast("long")
    return out.select(
        F.col("_row.doc_id").alias("doc_id"), n.alias("n_lines"), (n - F.size("_kept")).alias("n_dropped"),
        F.sha2(F.array_join("_kept", "\n"), 256).alias("kept_sha256"),
    )


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
gone AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM gone)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM gone)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""

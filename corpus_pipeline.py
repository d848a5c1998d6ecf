"""The corpus pipeline: quality, repeated lines, near duplicates, benchmark leaks, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import leaks, lines, near, pieces, quality
from gridwright.llm.shared import Scratch


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null and empty texts are scored like others; equal rows get equal verdicts."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "_score"
    while name in docs.columns:
        name += "_"
    return quality.score(docs, machine, out=name).where(F.col(name) >= quality.CUT).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in at least ten documents go everywhere; n_chars follows the text. A document may end up empty; a null text stays null."""
    out = lines.dedup_lines(docs, min_docs=10)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets that overlap by 0.8 or more, the one with the least doc_id. Documents without a word all
    stay; of rows with equal doc_id in a group one does."""
    return near.dedup_near(docs, k=5, num=8, den=10)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item. Null and empty texts hold none; rows with an equal or null doc_id are judged by their own texts."""
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and its token ids, with the digest of what they decode to: a row for each row, null texts without ids."""
    ids = pieces.encode(docs.select("doc_id", "text"), keep_text=False)
    out = pieces.decode(ids).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded_sha256")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("sentencepiece", tokenise),
]

#: Models, signatures and alignments have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{number}")
        if number:
            scratch.drop(f"stage{number - 1}")
    return docs

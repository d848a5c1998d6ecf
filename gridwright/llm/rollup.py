"""Token counts as rollups that batches of signed changes keep up to date.

A batch brings documents' present texts or counts, or their removal. Against the state before it, every document gives +1 for
what it is now and -1 for what it was; those deltas are summed by source, language and tokenizer version and added to the totals.
`Ledger.revise` takes texts: only documents whose text (by a 128-bit digest), source or language differ from the state are
tokenised, so a batch costs what it changes. `Ledger.commit` takes counts made elsewhere.

Each batch lives in a folder of the ledger named after its id, written in overwrite mode and followed by a marker. A ledger that
is opened on the folder again has the batches with a marker; what a crash left without one counts for nothing and is
overwritten. So a batch that is committed again, or again after a crash, changes nothing. After every COMPACT batches their rows
are merged into one state, with a marker of its own, and only then deleted: a commit reads the live documents' rows and a few
batches, not the history. One driver writes at a time.

Cases: a null text has 0 tokens; null sources, languages and tokenizers are groups of their own; rows with equal doc_id in a batch
add up; a document both revised and removed in a batch is taken back once and stands as revised; a removal of an unknown
document changes nothing; groups that fall to no documents leave the totals; a ledger without batches has empty totals.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import MODEL, encode
from .shared import Scratch

GROUP = ["source", "lang", "tokenizer"]
VALUES = ["n_docs", "n_tokens"]
COMPACT = 8


def text_key(text: Column) -> Column:
    """128 bits of a text; null and empty are alike."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(F.hex(F.xxhash64(text)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), text)))


def token_counts(docs: DataFrame, tokenizer: str, model: str = MODEL) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_docs, n_tokens, text_key for each row."""
    rows = docs.select("doc_id", "source", "lang", "text", text_key(F.col("text")).alias("text_key"))
    ids = encode(rows, keep_text=False, model=model)
    return ids.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.size("token_ids").cast("long").alias("n_tokens"), "text_key")


def _added_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in VALUES]).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


class Ledger:
    """Committed batches: signed rows for each document, and their sums, in a shared folder that outlives the driver.

    folder: where they are; without it they are in scratch and go with it."""

    def __init__(self, scratch: Scratch, folder: str | None = None):
        self.scratch, self.folder = scratch, (folder or f"{scratch.root}/ledger").rstrip("/")
        self.batches: dict[str, tuple[DataFrame, DataFrame]] = {}
        self.merged: tuple[DataFrame, DataFrame] | None = None
        self.absorbed: set[str] = set()
        self.states = 0
        names = self._names()
        states = [n for n in names if n.startswith("state-") and self._exists(f"{n}/_COMMITTED")]
        if states:
            self._take_state(max(int(n.removeprefix("state-")) for n in states))
        for n in names:
            if n.startswith("batch-"):
                self._open(unquote(n.removeprefix("batch-")))

    # files
    def _at(self, path: str):
        """A path in the folder and its file system."""
        spark = self.scratch.spark
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return target, target.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        root, fs = self._at("")
        return [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []

    def _exists(self, path: str) -> bool:
        target, fs = self._at(path)
        return fs.exists(target)

    def _mark(self, place: str) -> None:
        marker, fs = self._at(f"{place}/_COMMITTED")
        fs.createNewFile(marker)

    def _read(self, place: str) -> tuple[DataFrame, DataFrame]:
        return tuple(self.scratch.spark.read.parquet(f"{self.folder}/{place}/{part}") for part in ("signed", "sums"))

    def _write(self, place: str, signed: DataFrame, sums: DataFrame | None = None) -> None:
        signed.write.mode("overwrite").parquet(f"{self.folder}/{place}/signed")
        rows = self.scratch.spark.read.schema(signed.schema).parquet(f"{self.folder}/{place}/signed")
        sums = rows if sums is None else sums
        _added_up(sums, GROUP).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{place}/sums")

    @staticmethod
    def _name(name: str) -> str:
        return f"batch-{quote(name, safe='')}"

    def _open(self, name: str) -> bool:
        """Whether the batch has its marker; if so, it counts."""
        if name in self.absorbed:
            return True
        if name not in self.batches and self._exists(f"{self._name(name)}/_COMMITTED"):
            self.batches[name] = self._read(self._name(name))
        return name in self.batches

    def _take_state(self, number: int) -> None:
        self.states, self.merged = number, self._read(f"state-{number}")
        self.absorbed = {r[0] for r in self.scratch.spark.read.parquet(f"{self.folder}/state-{number}/names").collect()}  # a row a batch
        self.batches = {n: x for n, x in self.batches.items() if n not in self.absorbed}

    def compact(self) -> None:
        """Merge all batches into one state. Their files and the state before go once the new state has its marker."""
        old, names, place = self.states, list(self.batches), f"state-{self.states + 1}"
        if not names:
            return
        sums = self._union(1)
        self._write(place, self.state(), sums)
        every = [(n,) for n in sorted(self.absorbed | set(names))]
        self.scratch.spark.createDataFrame(every, "name string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{place}/names")
        self._mark(place)
        self._take_state(old + 1)
        for gone in [self._name(n) for n in names] + [f"state-{old}"] * bool(old):
            target, fs = self._at(gone)
            fs.delete(target, True)

    # contents
    def _union(self, part: int) -> DataFrame | None:
        rows = None
        for frames in [self.merged] * bool(self.merged) + list(self.batches.values()):
            rows = frames[part] if rows is None else rows.unionByName(frames[part])
        return rows

    def state(self) -> DataFrame | None:
        """What each document counts for now."""
        rows = self._union(0)
        return None if rows is None else _added_up(rows, ["doc_id", *GROUP, "text_key"])

    def totals(self) -> DataFrame:
        rows = self._union(1)
        if rows is None:
            return self.scratch.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        return _added_up(rows, GROUP).where("n_docs != 0")

    # changes
    def revise(self, name: str, docs: DataFrame, tokenizer: str, model: str = MODEL) -> None:
        """docs (doc_id, source, lang, text) are what these documents are now. Those that are in the ledger as they are stay untouched."""
        if self._open(name):
            return
        docs = docs.select("doc_id", "source", "lang", "text")
        before = self.state()
        if before is not None:
            key = ["doc_id", "source", "lang", "text_key"]
            now = docs.select("doc_id", "source", "lang", text_key(F.col("text")).alias("text_key")).groupBy(*key).agg(F.count("*").alias("n_docs"), F.lit(True).alias("_now"))
            was = before.where(F.col("tokenizer") == tokenizer).select(*key, "n_docs", F.lit(False).alias("_now"))
            # a document is touched if it comes now and some row of it is not the same before and now
            rows = now.unionByName(was).groupBy(*key, "n_docs").agg(F.max("_now").alias("_now"), F.min("_now").alias("_only_now"))
            touched = rows.groupBy("doc_id").agg(F.max("_now").alias("_now"), F.max(F.col("_now") == F.col("_only_now")).alias("_differs")).where("_now and _differs")
            touched = self.scratch.save(touched.select(F.col("doc_id").alias("_touched")), f"touched-{quote(name, safe='')}")
            docs = docs.join(touched, F.col("doc_id").eqNullSafe(F.col("_touched")), "left_semi")
        self.commit(name, token_counts(docs, tokenizer, model))

    def commit(self, name: str, counts: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """counts: revised or new rows (text_key may be left out); a document's rows of the same tokenizer version before it are taken
        back. removed: doc_ids (and versions) to take out. A batch name that is committed already is left as it is."""
        if self._open(name) or (counts is None and removed is None):
            return
        if counts is None:  # nothing comes in; the batch is committed all the same
            nothing = [F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
            counts = removed.select("doc_id", *nothing, F.col("tokenizer"), *[F.lit(0).cast("long").alias(v) for v in VALUES]).where("false")
        if "text_key" not in counts.columns:
            counts = counts.withColumn("text_key", F.lit(None).cast("string"))
        kept = f"counts-{quote(name, safe='')}"
        counts = self.scratch.save(counts.select("doc_id", *GROUP, *VALUES, "text_key"), kept)  # read for the change, and for the ids that it revises
        before, signed = self.state(), counts
        if before is not None:
            keys = [x.select(F.col("doc_id").alias("_doc_id"), F.col("tokenizer").alias("_tokenizer")) for x in (counts, removed) if x is not None]
            seen = (keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])).distinct()
            old = before.join(seen, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("tokenizer").eqNullSafe(F.col("_tokenizer")), "left_semi")
            signed = signed.unionByName(old.select("doc_id", *GROUP, *[F.negative(v).alias(v) for v in VALUES], "text_key"))
        place = self._name(name)
        self._write(place, _added_up(signed, ["doc_id", *GROUP, "text_key"]))
        self._mark(place)
        self.scratch.drop(kept, f"touched-{quote(name, safe='')}")
        self._open(name)
        if len(self.batches) > COMPACT:
            self.compact()


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents go in; then all come again with the bars of their tables taken out; then the documents that this revised
    are removed, and put in again. Every batch is sent twice, the second time to a ledger that is opened anew."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    bare = lambda df: df.withColumn("text", F.replace("text", F.lit(" | "), F.lit(" ")))
    plain, tables = bare(docs), bare(docs.where(F.contains("text", F.lit(" | "))))
    version = "piece_bpe_32k"
    scratch = Scratch(spark)
    for name, rows in (("insert", docs), ("revise", plain), ("remove", None), ("put back", tables)):
        for _ in range(2):
            ledger = Ledger(scratch)
            if rows is None:
                ledger.commit(name, removed=tables.select("doc_id", F.lit(version).alias("tokenizer")))
            else:
                ledger.revise(name, rows, version)
    return ledger.totals()

import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridwright.llm import rollup
from gridwright.llm.shared import Scratch

ROW = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long"


def totals(book):
    return {tuple(r) for r in book.totals().collect()}


def test_a_reopened_ledger_has_what_was_committed(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), ROW)
    opened = lambda: rollup.Ledger(Scratch(spark), f"file://{tmp_path}/book")
    first = frame((1, "a", "en", "v1", 1, 10), (2, "a", None, "v1", 1, 5), (3, None, "en", "v1", 1, 7))
    gone = frame((2, "", "", "v1", 0, 0)).select("doc_id", "tokenizer")
    opened().commit("early removal", removed=gone)
    opened().commit("2026/07 *%", first)
    opened().commit("early removal", removed=gone)
    opened().commit("2026/07 *%", first)
    assert totals(opened()) == {("a", "en", "v1", 1, 10), ("a", None, "v1", 1, 5), (None, "en", "v1", 1, 7)}
    for _ in range(2):  # document 1 is revised and removed in one batch
        opened().commit("next", frame((1, "b", "en", "v1", 1, 11)), removed=frame((1, "", "", "v1", 0, 0), (2, "", "", "v1", 0, 0)))
    assert totals(opened()) == {("b", "en", "v1", 1, 11), (None, "en", "v1", 1, 7)}
    opened().commit("again", frame((2, "a", None, "v1", 1, 5)))
    assert totals(opened()) == {("b", "en", "v1", 1, 11), (None, "en", "v1", 1, 7), ("a", None, "v1", 1, 5)}


def test_a_batch_that_a_crash_cut_off_counts_for_nothing(spark, tmp_path, monkeypatch):
    frame = lambda *rows: spark.createDataFrame(list(rows), ROW)
    opened = lambda: rollup.Ledger(Scratch(spark), f"file://{tmp_path}/book")
    opened().commit("1", frame((1, "a", "en", "v1", 1, 10)))
    book, at = opened(), rollup.Ledger._at

    def crash(self, path):
        if path == "batch-2/_COMMITTED" and (tmp_path / "book/batch-2/sums").exists():
            raise OSError
        return at(self, path)

    monkeypatch.setattr(rollup.Ledger, "_at", crash)
    with pytest.raises(OSError):
        book.commit("2", frame((1, "b", "en", "v1", 1, 99)))
    monkeypatch.undo()
    assert totals(opened()) == {("a", "en", "v1", 1, 10)}
    for _ in range(2):
        opened().commit("2", frame((1, "b", "en", "v1", 1, 11)))
    assert totals(opened()) == {("b", "en", "v1", 1, 11)}


def test_only_what_changed_is_tokenised_and_batches_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollup, "COMPACT", 2)
    seen = []

    def counted(docs, tokenizer, model):
        rows = docs.collect()
        seen.append(sorted(r.doc_id or 0 for r in rows))
        return spark.createDataFrame([(r.doc_id, r.source, r.lang, tokenizer, 1, len(r.text or "")) for r in rows], ROW).join(
            docs.select("doc_id", "source", rollup.text_key(F.col("text")).alias("text_key")).distinct(), ["doc_id", "source"]
        )

    monkeypatch.setattr(rollup, "token_counts", counted)
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, source string, lang string, text string")
    opened = lambda: rollup.Ledger(Scratch(spark), f"file://{tmp_path}/book")
    one, two = frame((1, "a", "en", "xyz"), (2, "a", "en", None), (3, "b", "en", "q")), frame((1, "a", "en", "xyz"), (2, "a", "en", "long"), (3, "c", "en", "q"))
    for name, rows in (("1", one), ("2", two), ("3", two), ("4", one.limit(0)), ("5", frame((9, "a", "en", "ab"))), ("2", one)):
        for _ in range(2):
            opened().revise(name, rows, "v1")
    assert seen == [[1, 2, 3], [2, 3], [], [], [9]]
    assert totals(opened()) == {("a", "en", "v1", 3, 9), ("c", "en", "v1", 1, 1)}
    names = {x.name for x in (tmp_path / "book").iterdir() if not x.name.startswith(".")}
    assert len([n for n in names if n.startswith("state-")]) == 1 and len(names) <= 3
    opened().commit("6", removed=frame((9, "", "", "")).selectExpr("doc_id", "'v1' AS tokenizer"))
    assert totals(opened()) == {("a", "en", "v1", 2, 7), ("c", "en", "v1", 1, 1)}


def test_empty_ledger_and_odd_rows(spark):
    book = rollup.Ledger(Scratch(spark))
    assert totals(book) == set() and book.state() is None
    rows = [(None, None, None, "ab"), (None, None, None, "ab"), (1, "a", None, None), (2, "a", "en", "")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, source string, lang string, text string, text_key string")
    for name in ("x", "y"):
        book.revise(name, docs, "v")
    assert {(r.source, r.lang, r.n_docs) for r in book.totals().collect()} == {(None, None, 2), ("a", None, 1), ("a", "en", 1)}
    book.revise("none", docs.limit(0), "v")
    assert sum(r.n_docs for r in book.totals().collect()) == 4


def test_the_query_equals_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=rollup.MODEL)
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        n = want.setdefault((r.source, r.lang, "piece_bpe_32k"), [0, 0])
        n[0] += 1
        n[1] += len(model.encode((r.text or "").replace(" | ", " ")))
    assert {(*k, *v) for k, v in want.items()} == {tuple(r) for r in rollup.op8_token_counts(spark, "/root/testdata/sf0.001").collect()}


def test_columns_of_the_documents_may_have_any_name(spark):
    ledger = rollup.Ledger(Scratch(spark))
    docs = spark.createDataFrame([(1, "s", "en", "a b c", 9, "x"), (2, "s", "en", None, 9, "x")], "doc_id long, source string, lang string, text string, _touched int, _now string")
    ledger.revise("a", docs, "v")
    ledger.revise("b", docs.withColumn("text", F.lit("a b")), "v")
    assert [tuple(r)[:4] for r in ledger.totals().collect()] == [("s", "en", "v", 2)]

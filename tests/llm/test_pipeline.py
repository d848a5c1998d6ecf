"""Each stage of the pipeline against a plain version of it, on the rows that the stage before it left."""

import hashlib
import re

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
from test_lines import brute as brute_lines
from test_near import brute as brute_near

from gridwright.llm import leaks, pieces, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    """The documents and what each stage makes of them."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], SF)
        out.append(spark.createDataFrame(made.collect(), made.schema))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(frames):
    for before, after in zip(frames[:-2], frames[1:-1], strict=True):
        assert after.columns == before.columns and after.count() <= before.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near duplicates", "benchmark decontamination", "sentencepiece"]


def test_quality_drops_what_all_pairs_reject(spark, frames):
    machine = quality.train(frames[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = set()
    for i, text in texts(frames[0]):
        _, places, values = quality.features([(text or "").encode()])
        x = np.zeros(quality.DIMS)
        np.add.at(x, places, values)
        # colliding words are features of their own in the sums of squares
        vx = machine.factors[places] * values[:, None]
        pairs = sum(float(vx[a] @ vx[b]) for a in range(min(len(vx), 400)) for b in range(a)) if len(vx) <= 400 else float(((vx.sum(0) ** 2) - (vx**2).sum(0)).sum() / 2)
        z = machine.bias + float(machine.linear @ x) + pairs
        if 1 / (1 + np.exp(-z)) >= quality.CUT:
            want.add(i)
    assert {i for i, _ in texts(frames[1])} == want and 0 < len(want) < frames[0].count()


def test_lines_are_those_of_brute_force(frames):
    assert {i: t or "" for i, t in texts(frames[2])} == brute_lines(texts(frames[1]), 10)
    assert all(r.n_chars == len(r.text or "") for r in frames[2].collect())


def test_one_of_each_group_stays(frames):
    assert {i for i, _ in texts(frames[3])} == {i for i, n, _, kept in brute_near(texts(frames[2]), 5, 8, 10) if kept}


def test_leaks_are_those_of_full_alignment(spark, frames):
    items = [(r.item_id, w) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(w := leaks.word_hashes([(r.text or "").encode()])[0])]
    want = set()
    for i, text in texts(frames[3]):
        words = leaks.word_hashes([(text or "").encode()])[0]
        scores = leaks.align([w for _, w in items], [words] * len(items)) if len(words) else np.zeros(len(items))
        if not any(s >= leaks.CUT * len(w) for s, (_, w) in zip(scores, items, strict=True)):
            want.add(i)
    assert {i for i, _ in texts(frames[4])} == want and len(want) < frames[3].count()


def test_tokens_are_the_librarys(frames):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = {r.doc_id: r for r in frames[5].collect()}
    assert len(rows) == frames[4].count()
    for i, text in texts(frames[4]):
        assert rows[i].token_ids == model.encode(text or "") and rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_odd_documents(spark):
    """Nulls in any column, empty texts, repeated rows and columns with clashing names pass every stage."""
    rows = [(None, None, None, None, None), (None, "", "en", "s", 0), (7, "Some plain words that stand here. " * 20, "en", None, 5), (7, "Some plain words that stand here. " * 20, "en", None, 5), (8, "é" * 3000, None, "s", None)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _text string, _score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[:2] == ["doc_id", "text"] and docs.columns[-2:] == ["_text", "_score"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() <= 4
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() == 0


def test_no_stage_reads_a_part(frames):
    """The stages' source names no limit, sample or modulus."""
    import inspect

    assert not re.search(r"\.(limit|sample|head|take)\(|%\s*\d", inspect.getsource(corpus_pipeline))

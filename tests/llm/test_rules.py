import re
from collections import Counter

from pyspark.sql import functions as F

from gridwright.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def covered(words):
    windows = list(zip(words, words[1:], words[2:], strict=False))
    n = Counter(windows)
    return len({i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)})


def plain(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": covered(words),
    }


TEXTS = [
    None, "", "\n\n \t", "a b c a b c", "one\none\n one\n\n\none", "#a |b| <c>\x0b$", "été 日本語 😀 été 日本語 😀", "a a a a a", "x\r\ny\r\nx\r\ny", "a\x00b \x1fc\xa0d",
    "the cat and the dog sat on it. " * 400, " ".join(f"w{i}" for i in range(3000)), "x" * 200_000, " ".join(f"the of w{i}" for i in range(60)),
]


def test_measures_and_verdicts_equal_the_plain_ones(spark):
    rows = [(i % 7 or None, t, "x", 1) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, _text int")
    got = rules.judge(rules.measure(docs, prefix="q_"), prefix="q_").collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(r.text)
        assert {k: r["q_" + k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r.q_base_failed == failed and r.kept == "x" and r.q_kept == (not r.q_failed_rules) and not (failed and r.q_kept)
    kept = rules.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == 2
    assert rules.filter_quality(docs.limit(0)).count() == 0


def test_windows_with_one_hash_are_compared_whole(spark):
    df = spark.createDataFrame([(t,) for t in ("a b c a b c", "x y z q x y z x y", "a b c d a b d c a b c", "p q r s")], "t string")
    w = F.split("t", " ")
    same = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x: F.lit(7).cast("long"))
    for r in df.withColumn("w", w).withColumn("h", same).select("t", rules._repeat_words(F.col("w"), F.col("h")).alias("n")).collect():
        assert r.n == covered(r.t.split())


def test_a_ratio_at_its_bound_passes(spark):
    df = spark.createDataFrame([(10, 1), (10, 2), (0, 0), (0, 1)], "n_words long, n_symbols long")
    rule = rules.Rule("r", "n_symbols", "n_words", high=(1, 10))
    assert [r[0] for r in df.select(rule.broken(F.col)).collect()] == [False, True, False, True]


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = rules.op12_quality_rules(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.02

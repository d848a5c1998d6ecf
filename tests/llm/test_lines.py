import re
from collections import defaultdict

import pytest

from gridwright.llm import lines


def brute(docs, least):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    out = {}
    for i, t in docs:
        rows = (t or "").split("\n")
        out[i] = "\n".join(x for x in rows if not key(x) or len(seen[key(x)]) < least)
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
def test_lines_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "hot_limit", lambda total, least: hot)
    docs = [(i, "\n".join(["Head " if i % 2 else "\thead", f"own {i}", "", "É x" if i % 3 else "é x", "tail", "tail"][: 1 + i % 6])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "x\n" * 80 + "head")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text or "" for r in lines.dedup_lines(df, min_docs=10).collect()}
    assert got == brute(docs, 10)


def test_first_occurrences_stay(spark):
    df = spark.createDataFrame([(2, "a\nb", "x"), (1, "A\na\nc", "y"), (None, "b\nd", None)], "doc_id long, text string, _pos string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df, min_docs=1, keep_first=True).collect()}
    assert got == {1: "A\nc", 2: "", None: "b\nd"}
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, "same\nx")] * 12, "doc_id long, text string")
    assert {r.text for r in lines.dedup_lines(df, min_docs=10).collect()} == {"same\nx"}

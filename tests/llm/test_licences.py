import random
import re

from gridwright.llm import licences


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_places_equal_brute_force(spark):
    odd = [(1, None), (2, ""), (3, "cc by"), (4, "CC-BY\x00cc\nby cc by"), (5, "by cc"), (6, "general"), (7, "public license"), (7, "All rights  reserved. éall rights reserved")]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(i - 100, t) for i, t in odd], "doc_id long, text string"))
    rows = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    for d in docs.collect():
        if d.doc_id != -93:
            r = rows[d.doc_id]
            assert tuple(r)[1:6] == brute(d.text), d.doc_id
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates(spark):
    docs = spark.createDataFrame([(1, "x Released under the MIT License."), (2, "the mit of license"), (3, "Apache License, Version 2.0")], "doc_id long, text string")
    rows = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    assert rows[1].labels == "mit" and rows[1].score > 0.999 and rows[2].labels == "" and rows[3].labels == "apache-2.0" and 0 < rows[3].score < 1
    assert licences.scan_licences(docs.limit(0)).count() == 0


def stands(words, phrase):
    p = phrase.split()
    return any(words[i : i + len(p)] == p for i in range(len(words) - len(p) + 1))


def test_labels_equal_brute_force(spark):
    rng = random.Random(5)
    every = [w for t in licences.TEMPLATES for w in t.text.split()]
    docs = []
    for i in range(400):
        words = [rng.choice(every) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(licences.TEMPLATES).text.split()
            t = [w if rng.random() > 0.05 else rng.choice(["", "x y", rng.choice(every)]) for w in t]
            at = rng.randint(0, len(words))
            words[at:at] = t
        docs.append((i, " ".join(words)))
    docs += [(1000, "w " * 100_000 + licences.TEMPLATES[2].text + " z" * 100_000), (1001, licences.TEMPLATES[2].text.replace("documentation files", "papers and other files"))]
    labels = set()
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        words = text.split()
        want = {t.label for t in licences.TEMPLATES if all(stands(words, p) for p in t.phrases)} | {x for p, x in licences.BASE.items() if stands(words, p)}
        assert set(filter(None, got[i].labels.split(","))) == want, i
        labels |= want
    assert len(labels) > 12 and got[1000].score > 0.999 and 0.8 < got[1001].score < 1


def test_odd_rows(spark):
    rows = [(None, "cc by"), (7, "cc by"), (7, "cc by"), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, labels string, n_words string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels) for r in licences.scan_licences(docs).collect())
    assert got == [(0, 2, 1, "cc-by"), (7, 2, 1, "cc-by"), (7, 2, 1, "cc-by"), (8, 0, 0, ""), (9, 0, 0, "")]

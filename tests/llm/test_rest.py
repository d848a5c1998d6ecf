import hashlib
import random

import numpy as np
import pytest

from gridwright.llm import chunks, syncmers


def test_edited_texts_follow_the_order(spark):
    docs = [(5, "abcdefgh" * 9), (3, None), (9, "xyzé" * 30), (1, "q" * 7), (2, "short")]
    out = {r.doc_id: r for r in syncmers.edited_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = sorted(docs, reverse=True)
    assert len(out) == 5
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert out[i].n_chars == len(a) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert syncmers.edited_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = syncmers.edited_pairs(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_syncmers_are_those_of_the_definition():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé ") for _ in range(n)) for n in (0, 4, 12, 200, 13)]
    owner, place, _ = syncmers.anchors(texts)
    from gridwright.llm.words import U, chain

    want = set()
    for i, x in enumerate(texts):
        p = np.array([ord(c) for c in x], U)
        if 0 < len(x) < syncmers.K:
            want.add((i, 0))
        for j in range(len(x) - syncmers.K + 1):
            inner = chain(p[j : j + syncmers.K], syncmers.S)
            if inner.min() in (inner[0], inner[-1]):
                want.add((i, j))
    assert set(zip(owner.tolist(), place.tolist(), strict=True)) == want


def test_repeated_passages(spark):
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passages = [say(rng.randint(52, 90)) for _ in range(30)]
    docs, holders = [], {}
    for i in range(200):
        t = say(rng.randint(0, 300))
        if i % 3 == 0:
            p = rng.randrange(30)
            holders.setdefault(p, set()).add(i)
            t = t[: len(t) // 2] + " " + passages[p] + " " + t[len(t) // 2 :]
        docs.append((i, t))
    docs += [(800, None), (801, ""), (802, "the " * 400)]
    out = chunks.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == {i for v in holders.values() if len(v) > 1 for i in v}
    kept = dict(chunks.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert len(kept) == len(docs) and all(len(kept[i]) < len(dict(docs)[i]) for v in holders.values() for i in v if i != min(v)) and kept[0] == docs[0][1]


def plain_fingerprint(text):
    """By the definition, one number at a time."""
    full, prime = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    def chain(points):
        h = len(points)
        for p in points:
            h = mix((h * prime + p) & full)
        return h

    p = [ord(c) for c in text]
    grams = [p] * (0 < len(p) < syncmers.K) + [p[i : i + syncmers.K] for i in range(len(p) - syncmers.K + 1)]
    bins = {}
    for g in grams:
        inner = [chain(g[i : i + syncmers.S]) for i in range(len(g) - syncmers.S + 1)]
        if len(g) < syncmers.K or min(inner) in (inner[0], inner[-1]):
            x = mix(chain(g))
            bins[x % syncmers.BINS] = min(bins.get(x % syncmers.BINS, full), x >> 8)
    return "".join(f"{mix(bins[b]) >> 48:04x}" if b in bins else "----" for b in range(syncmers.BINS))


def plain_likeness(a, b):
    cells = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
    used = [(x, y) for x, y in cells if (x, y) != ("----", "----")]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def test_fingerprints_and_likenesses_are_those_of_the_definition(spark, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", "q", "elevenchars", "twelve chars", "same text here, twice over", "same text here, twice over"] + ["".join(rng.choice("abcé 日") for _ in range(rng.randint(0, 400))) for _ in range(25)]
    docs = list(enumerate(texts))
    out = {r.doc_id: r for r in syncmers.edited_pairs(spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, _block string")).collect()}
    order = docs[::-1]
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        own, other, after = plain_fingerprint(a), plain_fingerprint(edited), plain_fingerprint(b)
        r = out[i]
        assert (r.fingerprint, r.edited_fingerprint) == (own, other) and abs(r.near_edited - plain_likeness(own, other)) < 1e-12 and abs(r.near_next - plain_likeness(own, after)) < 1e-12
    whole = syncmers.fingerprints([t or "" for t in texts])
    monkeypatch.setattr(syncmers, "PIECE", 40)
    assert (syncmers.fingerprints([t or "" for t in texts]) == whole).all()


def test_odd_ids_in_the_order(spark):
    rows = [(None, "a" * 30), (5, "b" * 30), (5, "c" * 30), (5, "c" * 30), (None, None)]
    out = syncmers.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in out) == [(0, 0), (0, 30), (5, 30), (5, 30), (5, 30)]


def test_spans_of_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(70))
    rows = [(None, words, 1), (3, "x " + words, 1), (3, "x " + words, 1), (4, None, 2), (5, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    assert {r.doc_id for r in chunks.repeated_spans(df).collect()} == {None, 3}
    kept = chunks.drop_repeats(df)
    assert kept.columns == df.columns and kept.count() == 5
    assert chunks.repeated_spans(df.limit(0)).count() == 0 and chunks.drop_repeats(df.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from gridwright.llm import shared

    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_folder(Session)

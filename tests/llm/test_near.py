import random
import re

import pytest

from gridwright.llm import near


def brute(docs, k, num, den):
    sets = {}
    for i, t in docs:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    docs = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([2, 4, 30, 120]))]
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word().upper()
            docs.append(" ".join(w) + rng.choice(["", "\n", "  "]))
    docs += [None, "", " \t\n", "one", "ONE", "two words", "a b c", "A  b\tc"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 8, 10)])
def test_components_equal_brute_force(spark, k, num, den):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in near.near_duplicates(df, k, num, den).collect()} == brute(docs, k, num, den)


def test_blocks_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(near, "CLUSTER_BYTES", 6000)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in near.near_duplicates(df, 3, 85, 100).collect()} == brute(docs, 3, 85, 100)


def test_odd_rows(spark):
    rows = [(None, "x y z"), (None, "x y z"), (4, "x y z w"), (4, "x y z w"), (5, None), (5, None), (6, "")]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, _key string, _n int")
    out = near.dedup_near(df, 3, 85, 100)
    assert out.columns == df.columns
    assert sorted((r[0] or 0, r[1] or "") for r in out.collect()) == [(0, "x y z"), (0, "x y z"), (4, "x y z w"), (5, ""), (5, ""), (6, "")]
    assert near.dedup_near(df.limit(0)).count() == 0


def test_superminhash_estimates_the_overlap():
    import numpy as np

    a = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = near.superminhash([a, a[:200], a[:3], a[:3]])
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.12
    assert (s[2] == s[3]).all()


def test_rows_with_one_doc_id_in_several_groups(spark):
    rows = [(1, "a b c d"), (1, "p q r s"), (5, "e f g h"), (5, "i j k l"), (2, "i j k l"), (None, "m n o p"), (None, "t u v w"), (9, "t u v w")]
    out = near.dedup_near(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100)
    assert sorted((r[0] or 0, r[1]) for r in out.collect()) == [(0, "m n o p"), (1, "a b c d"), (1, "p q r s"), (2, "i j k l"), (5, "e f g h"), (9, "t u v w")]


def test_words_that_differ_by_a_morse_sequence_are_not_linked(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_duplicates(docs, 3, 85, 100).collect()}
    assert got == {1: 1, 2: 2, 3: 1}

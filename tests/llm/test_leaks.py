import random

import numpy as np

from gridwright.llm import leaks


def slow(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -0.5), h[i, j + 1] - 0.5, h[i + 1, j] - 0.5)
    return h.max()


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(2)
    a = [rng.integers(2, 6, rng.integers(1, 12)).astype(np.uint64) for _ in range(40)]
    b = [rng.integers(2, 6, rng.integers(1, 20)).astype(np.uint64) for _ in range(40)]
    assert np.allclose(leaks.align(a, b), [slow(x, y) for x, y in zip(a, b, strict=True)])


def test_planted_copies_are_found_and_others_left(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 2000)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    vocabulary = [word() for _ in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.randint(15, 60)) for _ in range(30)]
    docs, planted = [], set()
    for i in range(200):
        w = say(rng.randint(5, 300))
        if i % 4 == 0:
            item = rng.randrange(len(items))
            copy = [rng.choice(vocabulary) if rng.random() < 0.12 else x for x in items[item]]
            at = rng.randint(0, len(w))
            w[at:at] = copy
            planted.add((i, item))
        docs.append((i, " ".join(w).title() + "."))
    docs += [(900, None), (901, "")]
    out = leaks.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in out.collect()} == planted


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r)[:3] for r in leaks.contaminated(docs, items).collect()] == [(1, 1, 1.0)]
    assert leaks.decontaminate(docs, items.limit(0)).count() == 1
    assert leaks.decontaminate(docs.limit(0), items).count() == 0


def test_every_copy_that_reaches_the_cut_is_found(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.choice([3, 4, 16, 20, 25, 40])) for _ in range(40)]
    docs = []
    for i in range(240):
        item, kind, new = rng.choice(items), i % 6, lambda: "new%d" % rng.randrange(10**6)
        if kind < 3:
            rate = (0.2, 0.25, 0.33)[kind]
            copy = [y for x in item for y in (([new()], [], [x, new()])[rng.randrange(3)] if rng.random() < rate else [x])]
        elif kind < 5:  # every third or fourth word replaced
            copy = [new() if j % kind == kind - 1 else x for j, x in enumerate(item)]
        else:  # a word put in after every word
            copy = [y for x in item for y in (x, new())]
        docs.append((i, say(30) + copy + say(30)))
    want = set()
    for i, d in docs:
        for k, item in enumerate(items):
            if len(set(d) & set(item)) * 2 >= len(item) and slow(item, d) >= len(item) / 2:
                want.add((i, k))
    out = leaks.contaminated(
        spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    )
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want and len(want) > 150


def test_odd_rows(spark):
    item = "one two three four five six seven eight"
    docs = spark.createDataFrame([(None, "x " + item), (None, "clean"), (1, item.upper()), (1, item.upper()), (1, "clean too"), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "'y' AS _text", "1 AS item_id")
    items = spark.createDataFrame([("a", item), (None, item), ("c", None), ("d", "")], "item_id string, text string")
    found = sorted((r.doc_id or 0, r.item_id or "") for r in leaks.contaminated(docs, items).collect())
    assert found == [(0, ""), (0, "a"), (1, ""), (1, ""), (1, "a"), (1, "a")]
    kept = leaks.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "clean"), (1, "clean too"), (2, ""), (3, "")]
    short = items.selectExpr("cast(1 as smallint) AS item_id", "text").limit(1)
    assert {r.item_id for r in leaks.contaminated(docs, short).collect()} == {1}

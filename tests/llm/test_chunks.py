import random

import pytest

from gridwright.llm import chunks


def words_of(text):
    """Start and end byte of each word."""
    b, out, start = text.encode() + b" ", [], None
    for i, x in enumerate(b):
        if x in b" \t\n\v\f\r":
            if start is not None:
                out.append((start, i))
            start = None
        elif start is None:
            start = i
    return out


def windows(text, n=51):
    b, w = text.encode(), words_of(text)
    return [(w[i][0], w[i + n - 1][1], b[w[i][0] : w[i + n - 1][1]]) for i in range(len(w) - n + 1)]


def corpus():
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(n))
    passages = [say(rng.choice([50, 51, 51, 52, 60])) for _ in range(300)]
    docs = []
    for i in range(400):
        parts = [say(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), say(rng.randint(0, 30))]
        docs.append((i, "\n ".join(parts)))
    x, y, line = say(60), say(60), "a b, c " * 30
    docs += [(500, x), (501, y), (502, x + " " + y), (503, say(5) + " " + line), (504, line + say(5)), (505, None), (506, "q " * 400)]
    half, other = say(40), say(40)
    return docs + [(510, half + " " + say(3)), (511, other), (512, half + " " + other)]


@pytest.mark.parametrize("limit", [10**6, 3])
def test_spans_are_those_of_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(chunks, "hot_limit", lambda total: limit)
    docs = corpus()
    texts = {i: t or "" for i, t in docs}
    owners = {}
    for i, t in texts.items():
        for _, _, w in windows(t):
            owners.setdefault(w, set()).add(i)
    want = {i: {(a, z) for a, z, w in windows(t) if len(owners[w]) > 1} for i, t in texts.items()}
    spans = [r.asDict() for r in chunks.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    got = {i: set() for i in texts}
    for r in spans:
        span = texts[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]]
        assert r["n_words"] == len(words_of(span.decode())) > 50
        assert any(span in t.encode() for i, t in texts.items() if i != r["doc_id"])
        got[r["doc_id"]] |= {(a, z) for a, z, _ in windows(texts[r["doc_id"]]) if r["start_byte"] <= a and z <= r["end_byte"]}
    assert got == want and want[502] and want[503] and not want[512]
    for r in spans:
        span = texts[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]]
        assert r["other_doc_id"] != r["doc_id"] and span in texts[r["other_doc_id"]].encode()
        assert all(min(owners[w]) == r["first_doc_id"] for a, z, w in windows(texts[r["doc_id"]]) if (a, z) in want[r["doc_id"]] and (r["start_byte"], r["end_byte"]) == (a, z))


def test_every_first_window_stays(spark):
    docs = corpus()
    kept = dict(chunks.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    texts, first = dict(docs), {}
    for i, t in docs:
        for _, _, w in windows(t or ""):
            first.setdefault(w, i)
    gone = {i: [(a, z) for a, z, w in windows(t or "") if first[w] != i] for i, t in docs}
    for i, t in docs:
        if t is not None:
            drop = {x for a, z in gone[i] for x in range(a, z)}
            assert kept[i].encode() == bytes(c for x, c in enumerate(t.encode()) if x not in drop)
    assert kept[505] is None and kept[502].strip() == "" and texts[500] == kept[500]


def test_parts_of_a_long_text_have_its_windows(monkeypatch):
    monkeypatch.setattr(chunks, "PIECE", 700)
    rng = random.Random(9)
    text = " ".join("x" * rng.choice([1, 3, 6, 900 if i % 97 == 0 else 5]) + str(i % 7) for i in range(3_000)).encode()

    def found(parts):
        out = {}
        for p in parts:
            cut = chunks.Cut([(0, *p)])
            rows = zip(cut.place(cut.starts[cut.windows], cut.windows).tolist(), cut.number(cut.windows).tolist(), cut.digest(cut.windows, 51).tolist(), cut.place(cut.ends[cut.cuts], cut.cuts).tolist(), strict=True)
            for row in rows:
                out[row] = out.get(row, 0) + 1
        return out

    parts = list(chunks._overlapping(text, 51))
    assert len(parts) > 5 and found(parts) == found([(0, 0, text)]) and max(found(parts).values()) == 1


def morse(a, b):
    """Two words that no polynomial modulo 2**64 tells apart."""
    for _ in range(10):
        a, b = a + b, b + a
    return a, b


def test_words_that_differ_by_a_morse_sequence_are_not_equal(spark):
    a, b = morse("a", "b")
    rest = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"{a} {rest}", "x"), (2, f"{b} {rest}", "y"), (3, f"{a} {rest}", "z")], "doc_id long, text string, _row string")
    got = {(r.doc_id, r.other_doc_id, r.n_words) for r in chunks.repeated_spans(docs).collect()}
    assert got == {(1, 3, 51), (3, 1, 51)}
    kept = {r.doc_id: r.text for r in chunks.drop_repeats(docs.where("doc_id < 3")).collect()}
    assert kept == {1: f"{a} {rest}", 2: f"{b} {rest}"}


def test_rows_with_one_id_or_none_are_told_apart(spark):
    text = " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (None, text + " more"), (7, text), (7, "other")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.text) for r in chunks.drop_repeats(docs).collect())
    assert len(got) == 4 and sum(len(t) > 50 for _, t in got) == 1

import random

import pyarrow as pa
import pytest
import sentencepiece

from gridwright.llm import pieces

TEXTS = [
    "", " ", "  ", "a", " a", "a ", "\n", "a\nb", "\n\n x", "Hello world", "héllo  wörld\t\ttabs", "日本語テキスト", "emoji 🤖🤖 ok", "x" * 300, "=" * 77,
    "aaaaaaaaaaaabaaaaaaaaab", "http://example.com/a/b?c=d&e=f", "int main() { return 0; }\n    int x;", "▁under", "…‘’“”—", "\x00\x01", "ﬁ ﬂ Å Å",
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def random_texts(n=400):
    rng = random.Random(5)
    v = pieces.load().pieces[300:]
    out = []
    for _ in range(n):
        parts = [rng.choice(v).replace(pieces.SPACE, rng.choice([" ", ""])) for _ in range(rng.randint(1, 60))]
        out.append("".join(parts))
        out.append("".join(rng.choice("abcdefghinorst eéèu.,\n\t0123-") for _ in range(rng.randint(1, 200))))
    return out


def test_ids_equal_the_library(model):
    texts = TEXTS + random_texts()
    memo = pieces._Memo(pieces.load())
    flat, n = memo.encode(pa.array(texts))
    at = 0
    for x, k in zip(texts, n.tolist(), strict=True):
        assert flat[at : at + k].tolist() == model.encode(x), repr(x)
        at += k


def test_documents_equal_the_library_and_round_trip(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.join(pieces.op1_sentencepiece(spark, "/root/testdata/sf0.001"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.token_ids == model.encode(r.text) and r.round_trip and r.n_tokens == len(r.token_ids)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "k"), (1, "", "k"), (None, "a  b\n", "k"), (None, "a  b\n", None)], "doc_id long, text string, decoded string")
    out = pieces.decode(pieces.encode(df))
    assert sorted((r.decoded, len(r.token_ids)) for r in out.collect())[:2] == [("", 0), ("", 0)]
    assert [r.decoded for r in out.where("doc_id is null").collect()] == ["a  b\n"] * 2
    assert pieces.encode(df.limit(0)).count() == 0


def test_long_unbroken_words_equal_the_library(model):
    rng = random.Random(7)
    v = pieces.load()
    texts = [
        "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(20_000)), "=" * 9_001, "x y " + "-" * 6_000 + " z " + "q" * 4_097, "".join(rng.choice(v.pieces[300:]).strip(pieces.SPACE) for _ in range(3_000)),
        "".join(rng.choice("日本語🤖é") for _ in range(6_000)), "ab" * 3_000,
    ]
    flat, n = pieces._Memo(v).encode(pa.array(texts))
    edge = [0, *n.cumsum().tolist()]
    for i, x in enumerate(texts):
        assert flat[edge[i] : edge[i + 1]].tolist() == model.encode(x), i

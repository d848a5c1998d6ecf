import numpy as np
from pyspark.sql import functions as F

from gridwright.llm import quality


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.2, rng.standard_normal(6), rng.standard_normal((6, 3)))
    x = rng.standard_normal(6)
    z = m.bias + m.linear @ x + sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in range(6) for j in range(i + 1, 6))
    assert np.isclose(m.score(np.zeros(6, int), np.arange(6), x, 1)[0], 1 / (1 + np.exp(-z)))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op9_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    print(len(good), len(bad), good.predicted.mean(), (1 - bad.predicted).mean())
    assert good.predicted.mean() > 0.97 and (1 - bad.predicted).mean() > 0.9
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "a b", None)], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, none))
    assert [r.score for r in out.collect()] == [0.5] * 3
    some = spark.createDataFrame([(1, 1), (None, 0), (1, None)], "doc_id long, quality int")
    assert all(0.5 <= r.score < 1 for r in quality.score(docs, quality.train(docs, some)).collect())
    assert quality.score(docs.limit(0), quality.train(docs, none)).count() == 0
    assert docs.select(quality.held_out(F.col("doc_id")).alias("h")).where("doc_id is null").first().h


def test_the_sample_does_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40, f"word{i} and more text {'x' * (i % 7)}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a, b = (quality.train(d, labels, sample=25) for d in (docs.repartition(7, "text"), docs.coalesce(1)))
    assert a.bias == b.bias and (a.linear == b.linear).all() and (a.factors == b.factors).all()

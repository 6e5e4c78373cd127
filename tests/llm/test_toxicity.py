import numpy as np
from pyspark.sql import functions as F

from seqloom.llm import toxicity as t


def categories():
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumn("held", F.col("doc_id") % 4 == 0)
    chain = t.train_chain(docs, labels.where("NOT held"), categories())
    got = t.score(docs, chain).join(labels.where("held").withColumnRenamed("toxic", "is_toxic"), "doc_id").select("is_toxic", "toxic").collect()
    hits = sum(x.is_toxic == 1 and x.toxic for x in got)
    assert hits >= 0.9 * sum(x.is_toxic == 1 for x in got)
    assert sum(x.is_toxic == 0 and x.toxic for x in got) <= 0.01 * len(got)


def test_later_models_use_earlier_probabilities():
    r = np.random.default_rng(1)
    y = (r.random((600, 2)) < 0.4).astype(int)
    y[:, 1] = y[:, 0]
    lists = [np.array([7, *([3] if a else []), 10 + i % 5]) for i, (a, _) in enumerate(y)]
    folds = np.arange(600) % 4
    chain = t.fit_chain(lists, y, folds, ("a", "b"))
    assert chain.models[0].chain.size == 0 and chain.models[1].chain[0] > 0
    starts = np.r_[0, np.cumsum([len(x) for x in lists])]
    p = chain.probabilities(np.concatenate(lists), starts)
    assert ((p[:, 1] >= chain.cutoffs[1]) == y[:, 1]).all()


def test_minimum_is_found():
    f = lambda w: (float(((w - 3) ** 4).sum() + w @ w), 4 * (w - 3) ** 3 + 2 * w)
    w = t.minimise(f, np.zeros(5))
    assert np.abs(f(w)[1]).max() < 1e-4


def test_best_cutoff():
    assert 0.4 < t.best_cutoff(np.array([0.1, 0.4, 0.6, 0.9]), np.array([0, 0, 1, 1])) < 0.6
    assert t.best_cutoff(np.array([0.1, 0.1]), np.array([0, 0])) > 1


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, True), (1, "", True), (None, "bad bad", True), (2, "x " * 40_000, True)], "doc_id long, text string, toxic boolean")
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 0), (2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for chain in (t.train_chain(df, labels, categories()), t.train_chain(df, labels.limit(0), categories())):
        got = t.score(df, chain).collect()
        assert len(got) == 4 and not any(x.toxic for x in got)
        assert t.score(df.limit(0), chain).count() == 0

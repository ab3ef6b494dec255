import numpy as np

from riskpanel.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    return (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = T.toxicity(docs, labels).join(labels.select("doc_id", "toxic").where("toxic IS NOT NULL"), "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    assert len(rows) > 500 and s.min() >= 0 and s.max() <= 1
    assert auc(s, y) > 0.9 and (s[y == 1] >= 0.5).mean() > 0.7 and (s[y == 0] >= 0.5).mean() < 0.03
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(T.toxicity(docs, labels).collect()) == sorted(T.toxicity(docs, flipped).collect())


def test_awkward_rows(spark, awkward, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (6, None, None), (None, 1, 1), (99, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = T.toxicity(clashing, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert T.toxicity(empty, labels).count() == 0
    assert {r.score for r in T.toxicity(awkward, labels.limit(0)).collect()} == {0.0}

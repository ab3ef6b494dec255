import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in sound if i % 50 == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q and len(b) == len(a))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.integers(-3, 4, 4) / 8)]) for i in range(120)]
    rows += [(200 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(60)]  # a very common vector
    rows += [(50, rows[50][1]), (400, None), (401, [0.1, None, 0.1, 0.1]), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (None, [1.0] * 4),
             (404, [1.0, 1.0]), (450, [1.0, 0.5]), (500, []), (501, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    for block in (8192, 2):
        got = topk.search(df, F.col("vec_id") % 50 == 0, k=5, block=block)
        assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_scores_beyond_floating_point(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.integers(-2**20, 2**20, 3))]) for i in range(60)] + [(70, [3.0e30] * 3), (71, [2.0**21, 1.0, 2.0**21])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    with pytest.raises(Exception, match="too large|Overflow"):  # a score among the best that no long can hold
        topk.search(df, F.col("vec_id") % 50 == 0).collect()
    small = [r for r in rows if r[0] != 70]
    assert sorted(map(tuple, topk.search(df.where("vec_id <> 70"), F.col("vec_id") % 50 == 0).collect())) == brute(small, 5)


def test_long_vectors_whose_scores_fit(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 6e6]), (2, [1.0, 1.3e7]), (3, [2.0**41, 0.0]), (4, [1.0, 0.0]), (5, [-(2.0**40), 3e30])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute(rows, 5) and len(got) == 5 and got[0][3] == 2**57


def test_fewer_candidates_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (1, [-1.0], 0), (2, [0.5], 0)], SCHEMA)
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 2, 32768), (0, 2, 1, -65536)]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_query_matches_sql(spark, same_as_sql):
    sf = "/root/testdata/sf0.01"
    assert same_as_sql(queries.op4(spark, sf), queries.TOP_K_SQL, embeddings=f"{sf}/embeddings.parquet")

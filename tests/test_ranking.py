"""Distributed ranks and quantiles against numpy and pandas, with heavy ties."""

import numpy as np
import pandas as pd
import pytest

from riskpanel.operators import ranking as R


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    # One group and one value each hold a third of all rows.
    group = np.where(rng.random(n) < 1 / 3, "hot", rng.choice(["b", "c", "d"], n))
    value = np.where(rng.random(n) < 1 / 3, 7.0, np.round(rng.normal(0, 50, n), 1))
    return pd.DataFrame({"g": group, "x": value})


def test_rank_average_ties(spark, frame):
    got = R.rank_average_ties(spark.createDataFrame(frame), "x", "r").toPandas()
    want = frame.assign(r=frame.x.rank(ascending=False))
    assert sorted(zip(got.x, got.r)) == sorted(zip(want.x, want.r))


def test_exact_quantiles_match_linear_interpolation(spark, frame):
    got = R.exact_quantiles(spark.createDataFrame(frame), "x", ["g"], {"q25": 0.25, "med": 0.5, "q9": 0.9}).toPandas()
    for g, part in frame.groupby("g"):
        row = got[got.g == g].iloc[0]
        assert row.n == len(part)
        np.testing.assert_allclose([row.q25, row.med, row.q9], np.quantile(part.x, [0.25, 0.5, 0.9]))


def test_quantiles_of_a_group_with_a_missing_value_are_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), (None, 4.0), (None, 6.0)], "g string, x double")
    got = {r.g: (r.n, r.med) for r in R.exact_quantiles(df, "x", ["g"], {"med": 0.5}).collect()}
    assert got == {"a": (2, None), "b": (1, 2.0), None: (2, 5.0)}


def test_ordered_positions(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (2,)], "d int")
    assert sorted(map(tuple, R.ordered_positions(df, "d").collect())) == [(1, 1, 3), (2, 2, 3), (3, 3, 3)]

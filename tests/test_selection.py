"""Rule choice, regret, Pareto counts and switches on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.operators import selection as V
from riskpanel.operators import switches as W

QUARTERS = ["2021 2", "2022 1"]


def rows_of(spark, table):
    out = []
    for (kind, typ, var), values in table.items():
        for q, v in zip(["Overall", "Training", "Test", *QUARTERS], values):
            out.append(("Neutral", "L", typ, kind, var, q, "Weighted accuracy", v))
    return spark.createDataFrame(
        out, "lab string, lab2 string, type string, rule_kind string, var string, quarter string, metric string, metric_value double")


def test_best_static_keeps_ties_and_ignores_other_rules(spark):
    rows = rows_of(spark, {
        ("static", "H", "0 5 0"): [0.5, 0.8, 0.1, 0.5, 0.5], ("static", "H", "0 10 0"): [0.5, 0.8, 0.2, 0.5, 0.5],
        ("static", "H", "0 15 0"): [0.5, 0.7, 0.9, 0.5, 0.5], ("adaptive", "H", "Adaptive"): [0.9] * 5})
    assert sorted(r["var"] for r in V.best_static(rows, QUARTERS).collect()) == ["0 10 0", "0 5 0"]


def test_unknown_training_score_leaves_the_group_without_a_best_rule(spark):
    rows = rows_of(spark, {("static", "H", "0 5 0"): [0.5, 0.8, 0.1, 0.5, 0.5], ("static", "H", "0 9 0"): [0.5, None, 0.1, 0.5, 0.5]})
    assert V.best_static(rows, QUARTERS).count() == 0


def test_regret(spark):
    rows = rows_of(spark, {
        ("static", "H", "0 5 0"): [0.5, 0.8, 0.6, 0.70, 0.50], ("adaptive", "H", "Adaptive"): [0.6, 0.7, 0.7, 0.60, 0.90]})
    table = V.comparison_table(rows, QUARTERS, ["Adaptive"])
    got = {(r["var"], r["block"]): (r["value"], r["regret"]) for r in V.max_regret(table, ["2021 2"], ["2022 1"]).collect()}
    assert got["H", "Training MR"] == (0.0, 0.0) and got["Adaptive", "Training MR"] == (10.0, 10.0)
    assert got["H", "Test MR"] == (40.0, 40.0) and got["H", "Test"] == (60.0, 10.0)


def test_pareto_counts_against_pairs(spark):
    rng = np.random.default_rng(2)
    pts = [("a", f"r{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 8, (40, 2)) / 8)]
    df = spark.createDataFrame(pts, "g string, var string, Specificity double, Sensitivity double")
    got = {r["var"]: r["chk"] for r in V.pareto_counts(df, ["g"]).collect()}
    for _, v, x, y in pts:
        assert got[v] == sum(p[2] >= x and p[3] >= y for p in pts)


@pytest.mark.parametrize("series,chg,chg2", [([0, 1, 1, 0, 1], 3, 1), ([1, 1, 1], 0, 0), ([0, None, 1, 1, 0, 0], 1, 1)])
def test_switches(spark, series, chg, chg2):
    data = [("a", i, None if v is None else bool(v)) for i, v in enumerate(series)]
    df = spark.createDataFrame(data, "state string, ymd int, f boolean")
    assert {r["var"]: r["tot"] for r in W.switch_totals(df, ["f"]).collect()} == {"chg": chg, "chg2": chg2}


def test_switches_do_not_cross_areas(spark):
    df = spark.createDataFrame([("a", 1, True), ("b", 1, False), ("b", 2, False)], "state string, ymd int, f boolean")
    assert df.select(F.count(F.lit(1))).first()[0] == 3
    assert {r["tot"] for r in W.switch_totals(df, ["f"]).collect()} == {0}

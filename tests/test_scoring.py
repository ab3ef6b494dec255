"""Confusion matrices: hand-made frames, brute force over the long rule frame, and invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskpanel.operators import rules as R
from riskpanel.operators import scoring as S

OUTCOMES = ("zeke_time_3", "two_zeke_time_3", "icu_2_time_3", "perc_covid_10_time_3")


def full_frame(spark):
    obs = spark.range(100).select(F.lit(0.01).alias("weight"))
    for name, values in (("outcome_label", ["test1", "test2"]), ("outcome_value", [1.0, 0.0]), ("value", [1.0, 0.0])):
        obs = obs.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return obs


def test_every_cell_once(spark):
    got = S.confusion_metrics(full_frame(spark), ["outcome_label"]).toPandas()
    assert len(got) == 2 and (got.n == 400).all()
    for c in ("tp", "tn", "fp", "fn"):
        np.testing.assert_allclose(got[c], 1.0)
    for c in ("sens", "spec", "ppv", "npv", "percright", "w_acc"):
        np.testing.assert_allclose(got[c], 0.5)


def test_missing_cells_give_null_rates(spark):
    frame = full_frame(spark).withColumns(
        {"g1": F.col("outcome_value") == F.col("value"), "g2": F.col("outcome_value") == 1})
    got = S.confusion_metrics(frame, ["outcome_label", "g1", "g2"]).where("outcome_label = 'test1'").toPandas()
    hit = got[got.g1 & got.g2].iloc[0]
    assert hit.sens == 1 and pd.isna(hit.spec) and hit.ppv == 1 and pd.isna(hit.npv) and hit.w_acc == 1
    miss = got[~got.g1 & got.g2].iloc[0]
    assert miss.sens == 0 and pd.isna(miss.ppv) and miss.npv == 0 and miss.w_acc == 0


@pytest.mark.parametrize("mult,fn,fp", [(2.0, 4 / 3, 2 / 3), (0.5, 2 / 3, 4 / 3)])
def test_asymmetric_costs(spark, mult, fn, fp):
    got = S.confusion_metrics(full_frame(spark), ["outcome_label"], mult).toPandas().iloc[0]
    np.testing.assert_allclose([got.fn, got.fp, got.w_acc], [fn, fp, 1 - (fn + fp) / 4])


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    dates = pd.date_range("2021-01-06", periods=60, freq="7D")
    rows = []
    for s in range(12):
        for d in dates:
            rows.append((f"s{s}", d.date(), float(rng.integers(0, 6)), float(rng.integers(0, 6)), float(rng.integers(0, 30)),
                         float(rng.random() * 3), float(rng.random() * 4), float(rng.integers(1, 9)),
                         *[None if rng.random() < 0.1 else bool(rng.random() < 0.4) for _ in OUTCOMES],
                         None if rng.random() < 0.1 else bool(rng.random() < 0.5)))
    pdf = pd.DataFrame(rows, columns=["state", "ymd", "cases_weekly", "admits_weekly", "perc_covid_100", "deaths_now_weekly",
                                      "icu_weekly", "weight", *OUTCOMES, "cdc_flag"])
    schema = ("state string, ymd date, cases_weekly double, admits_weekly double, perc_covid_100 double, "
              "deaths_now_weekly double, icu_weekly double, weight double, "
              + ", ".join(f"{o} boolean" for o in OUTCOMES) + ", cdc_flag boolean")
    df = spark.createDataFrame([tuple(None if x is pd.NaT else x for x in r) for r in rows], schema)
    # Unknown inputs, so that the three-valued logic is exercised.
    hole = (F.hash("state", "ymd") % 7) == 0
    assert len(pdf) == df.count()
    return df.withColumns({"admits_weekly": F.when(~hole, F.col("admits_weekly")),
                           "perc_covid_100": F.when((F.hash("ymd", "state") % 5) != 0, F.col("perc_covid_100"))})


GRID = R.Grid(case=(1.0, 3.0), admit=(2.0, 4.0), perc=(5.0, 20.0), kind="CHO")
START, END, SPLIT = "2021-03-01", "2022-01-31", "2021-10-31"


def test_summing_cells_first_equals_the_long_frame(spark, panel):
    fast = S.rates(S.rule_sums(panel, [GRID], OUTCOMES, START, END, SPLIT)).toPandas()
    long = S.period_metrics(R.define_metrics(panel, GRID, OUTCOMES), ["var", "outcome_label"], START, END, SPLIT).toPandas()
    keys = ["var", "outcome_label", "quarter"]
    both = fast.merge(long, on=keys, suffixes=("", "_long"))
    assert len(both) == len(fast) == len(long)
    for c in ("n", "sens", "spec", "ppv", "npv", "percright", "fn", "fp", "pos", "neg", "w_acc", "n2"):
        np.testing.assert_allclose(both[c].astype(float), both[f"{c}_long"].astype(float), atol=1e-9, err_msg=c)


def test_long_frame_against_plain_loops(panel):
    pdf = R.define_metrics(panel, GRID, OUTCOMES[:2]).where("rule_kind = 'CHO'").toPandas()
    base = {(r.state, r.ymd): r for r in panel.collect()}

    def kleene(parts):
        return 0.0 if False in parts else (np.nan if None in parts else 1.0)

    for r in pdf.sample(400, random_state=1).itertuples():
        b = base[(r.state, r.ymd)]
        c, a, p = map(float, r.var.split())
        want = kleene([None if x is None else x >= t for x, t in
                       ((b.cases_weekly, c), (b.admits_weekly, a), (b.perc_covid_100, p))])
        assert (np.isnan(want) and np.isnan(r.value)) or want == r.value


def test_rules_are_monotone_in_each_threshold(panel):
    m = S.rates(S.rule_sums(panel, [GRID], OUTCOMES[:1], START, END, SPLIT, fixed_rules=False)).where(
        "quarter = 'Overall'").toPandas().set_index("var")
    assert m.loc["3 2 5"].pos <= m.loc["1 2 5"].pos
    assert m.loc["1 4 5"].pos <= m.loc["1 2 5"].pos
    assert m.loc["1 2 20"].pos <= m.loc["1 2 5"].pos


def test_repeating_rows_changes_counts_but_no_rate(panel):
    long = R.define_metrics(panel, GRID, OUTCOMES[:1]).where("var = 'current_zeke'")
    once = S.confusion_metrics(long, ["outcome_label"]).first()
    many = S.confusion_metrics(long.union(long).union(long), ["outcome_label"]).first()
    assert many.n == 3 * once.n
    for c in ("sens", "spec", "ppv", "npv", "percright", "w_acc"):
        assert abs(once[c] - many[c]) < 1e-12


def test_weighted_accuracy_is_accuracy_when_nothing_is_missing(panel):
    known = R.define_metrics(panel, GRID, OUTCOMES[:1]).where("outcome_value IS NOT NULL AND value IS NOT NULL")
    for r in S.confusion_metrics(known, ["var"]).collect():
        assert abs(r.w_acc - r.percright) < 1e-12


def test_unlabelled_rows_count_as_correct_in_weighted_accuracy(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (1.0, None, 1.0), (2.0, 0.0, 1.0)], "weight double, outcome_value double, value double")
    r = S.confusion_metrics(df.withColumn("g", F.lit(1)), ["g"]).first()
    assert (r.pos, r.neg, r.fp) == (4.0, 0.0, 2.0) and r.w_acc == 0.5


def test_current_state_rule_and_covariate_differ_for_beds(panel):
    long = R.with_outcomes(panel, OUTCOMES).where("outcome_label = 'perc_covid_10_time_3' AND perc_covid_100 > 10")
    assert long.where("z_rule <> 0").count() == 0 and long.where("z_cov <> 1").count() == 0

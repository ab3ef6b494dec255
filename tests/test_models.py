"""Training windows and grouped logistic fits: invariants, brute force, a library fit and degenerate cases."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from riskpanel.operators import forest as FO
from riskpanel.operators import logistic as L
from riskpanel.operators import training as T
from riskpanel.plans import estimates as E

OUTCOMES = ("zeke_time_3", "two_zeke_time_3")
STUDY = E.Study("2021-05-01", "2021-07-20", "2021-06-15")


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(30):
        w = float(rng.integers(1, 9)) / 100
        for k in range(30):
            h, c, o = rng.random(3) * [10, 6, 30]
            p = 1 / (1 + np.exp(-(0.4 * h - 2)))
            rows.append((f"s{s}", date(2021, 1, 6) + timedelta(days=7 * k), c, None if rng.random() < 0.05 else h, o,
                         float(rng.random() * 3), 1.0, w, 1 / 30,
                         None if rng.random() < 0.05 else bool(rng.random() < p), bool(rng.random() < p / 2),
                         float(rng.normal()), float(rng.normal()), float(rng.normal()), bool(rng.random() < 0.5)))
    schema = ("state string, ymd date, cases_weekly double, admits_weekly double, perc_covid_100 double, deaths_now_weekly double, "
              "icu_weekly double, weight double, weight_alt double, zeke_time_3 boolean, two_zeke_time_3 boolean, "
              "change_admits double, change_perc double, change_cases double, cdc_flag boolean")
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows], schema).cache()


@pytest.fixture(scope="module")
def fits(panel):
    dates = T.eval_dates(panel, STUDY.start, STUDY.end)
    return L.fit_logistic(L.model_rows(panel, OUTCOMES), dates, L.SPECS, OUTCOMES).cache()


def test_window_invariants(panel):
    dates = T.eval_dates(panel, "2021-04-01", "2021-07-20")
    for weeks in (4, 8):
        audit = T.window_audit(panel, T.weekly_windows(dates, weeks), weeks).toPandas()
        gap = (pd.to_datetime(audit.end_date) - pd.to_datetime(audit.max_train_date)).dt.days
        span = (pd.to_datetime(audit.max_train_date) - pd.to_datetime(audit.min_train_date)).dt.days
        full = audit[pd.to_datetime(audit.end_date) >= "2021-04-15"]
        assert (gap == 21).all()
        assert weeks == 8 or ((span + 7) / 7 == weeks).all()
        assert weeks == 8 or (full.n_rows == 30 * weeks).all()
    audit = T.window_audit(panel, T.quarterly_windows(dates), 1).toPandas()
    gap = (pd.to_datetime(audit.end_date) - pd.to_datetime(audit.max_train_date)).dt.days
    assert (gap >= 21).all()
    q = lambda d: pd.PeriodIndex(pd.to_datetime(d), freq="Q")
    assert (q(audit.end_date) - 1 == q(audit.max_train_date)).all()


def test_windows_of_any_weekday(spark):
    """Window keys are week buckets; membership must not depend on how dates fall into them."""
    days = spark.range(120).select(F.date_add(F.lit(date(2021, 1, 1)), F.col("id").cast("int")).alias("ymd"))
    ends = spark.range(30).select(F.date_add(F.lit(date(2021, 3, 10)), F.col("id").cast("int")).alias("end_date"))
    got = {(r.end_date, r.ymd) for r in T.in_windows(days, T.weekly_windows(ends, 3), 3).collect()}
    want = set()
    for e in (date(2021, 3, 10) + timedelta(days=i) for i in range(30)):
        for d in (date(2021, 1, 1) + timedelta(days=i) for i in range(120)):
            if e - timedelta(days=21 + 21) < d <= e - timedelta(days=21):
                want.add((e, d))
    assert got == want


def newton(x, y, w, steps=60):
    x = np.column_stack([np.ones(len(y)), x])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-x @ b))
        v = w * mu * (1 - mu)
        b = b + np.linalg.solve((x * v[:, None]).T @ x, x.T @ (w * (y - mu)))
    return b


@pytest.mark.parametrize("name", ["Adaptive: H", "Adaptive", "Adaptive: CHO", "Adaptive: CHODZ"])
def test_fits_match_brute_force(panel, fits, name):
    spec = L.spec(name)
    cols = [L.FEATURES[f] for f in spec.features]
    rows = L.model_rows(panel, OUTCOMES).select("outcome_label", "ymd", "outcome_value", "weight", *cols).toPandas()
    rows["ymd"] = pd.to_datetime(rows.ymd)
    order = {f: j for j, f in enumerate(L.FEATURES, 1)}
    for fit in fits.where(F.col("spec") == name).collect():
        end = pd.Timestamp(fit.end_date)
        t = rows[(rows.outcome_label == fit.outcome_label) & (rows.ymd > end - pd.Timedelta(days=49))
                 & (rows.ymd <= end - pd.Timedelta(days=21))].dropna()
        b = newton(t[cols].to_numpy(), t.outcome_value.to_numpy(), t.weight.to_numpy())
        got = [fit.b0] + [fit[f"b{order[f]}"] for f in spec.features]
        assert fit.n_train == len(t) and fit.state == "converged"
        np.testing.assert_allclose(got, b, rtol=1e-3, atol=1e-3)
        mu = lambda q: 1 / (1 + np.exp(-np.column_stack([np.ones(len(t)), t[cols]]) @ q))
        np.testing.assert_allclose(mu(np.array(got)), mu(b), atol=1e-4)


def test_fits_match_the_library_model(panel, fits):
    rows = L.model_rows(panel, OUTCOMES).where("outcome_label = 'zeke_time_3'")
    va = VectorAssembler(inputCols=["admits_weekly", "current_zeke"], outputCol="features", handleInvalid="skip")
    for fit in fits.where("spec = 'Adaptive' AND outcome_label = 'zeke_time_3'").orderBy("end_date").limit(3).collect():
        t = rows.where(F.col("ymd").between(fit.lo_date + timedelta(days=1), fit.hi_date)).na.drop(subset=["outcome_value"])
        glr = GeneralizedLinearRegression(family="binomial", weightCol="weight", labelCol="outcome_value", tol=1e-10, maxIter=50)
        m = glr.fit(va.transform(t))
        np.testing.assert_allclose([fit.b0, fit.b2, fit.b4], [m.intercept, *m.coefficients], rtol=1e-4, atol=1e-4)


def test_quarterly_fits_use_the_quarter_before(fits):
    for f in fits.where("spec = 'Simplified adaptive'").collect():
        assert f.weeks == 0 and pd.Period(f.lo_date + timedelta(days=1), "Q") == pd.Period(f.end_date, "Q") - 1


def test_degenerate_fits(spark, panel):
    """A constant covariate is dropped, one-sided labels run to a bounded fit, an empty window has no prediction."""
    flat = panel.withColumns({"deaths_now_weekly": F.lit(0.0), "two_zeke_time_3": F.lit(True)})
    rows = L.model_rows(flat, OUTCOMES)
    dates = spark.createDataFrame([(date(2021, 6, 2),), (date(2021, 1, 6),)], "end_date date")
    fits = L.fit_logistic(rows, dates, [L.spec("Adaptive"), L.spec("Adaptive: H")], OUTCOMES)
    by = {(f.spec, f.outcome_label, f.end_date): f for f in fits.collect()}
    aliased, plain = by["Adaptive", "zeke_time_3", date(2021, 6, 2)], by["Adaptive: H", "zeke_time_3", date(2021, 6, 2)]
    assert aliased.b4 == 0 and aliased.n_aliased == 1
    np.testing.assert_allclose([aliased.b0, aliased.b2], [plain.b0, plain.b2], atol=1e-9)
    assert by["Adaptive: H", "zeke_time_3", date(2021, 1, 6)].state == "empty"
    scored = L.score(rows, fits).where("outcome_label = 'two_zeke_time_3' AND admits_weekly IS NOT NULL")
    assert scored.where("pred < 0.999").count() == 0 and scored.count() > 0
    unfitted = L.score(rows, fits).where("ymd = DATE '2021-01-06'")  # no training rows: kept, without a prediction
    assert unfitted.count() > 0 and unfitted.where("pred IS NOT NULL").count() == 0
    assert L.score(rows, fits).where("admits_weekly IS NULL AND pred IS NOT NULL").count() == 0


def test_one_fit_serves_every_cost_ratio(panel, fits):
    """Sums per ratio from one scored table equal scoring each ratio on its own."""
    scored = L.score(L.model_rows(panel, OUTCOMES), fits).where("spec = 'Adaptive: CHO'").cache()
    cuts = (0.2, 1.0, 3.0)
    from riskpanel.operators import scoring as S

    got = S.rates(E.cost_sums(scored, ["outcome_label"], cuts, STUDY), F.col("mult")).toPandas()
    for m in cuts:
        one = scored.withColumn("value", L.predicted_class(F.col("pred"), m))
        want = S.period_metrics(one, ["outcome_label"], STUDY.start, STUDY.end, STUDY.split, m).toPandas()
        both = got[got.mult == m].merge(want, on=["outcome_label", "quarter"], suffixes=("", "_w"))
        assert len(both) == len(want)
        for c in ("sens", "spec", "w_acc", "fn", "fp"):
            np.testing.assert_allclose(both[c].astype(float), both[f"{c}_w"].astype(float), atol=1e-12)


def test_solver_batches_with_unused_and_aliased_columns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4))
    x[:, 3] = x[:, 1] * 2
    gram = np.stack([x.T @ x, x.T @ x])
    rhs = np.stack([x.T @ x[:, 0], x.T @ (x[:, 0] + x[:, 1])])
    used = np.array([[True, True, False, True], [True, True, True, True]])
    beta, kept = L.solve_systems(gram, rhs, used)
    np.testing.assert_allclose(beta, [[1, 0, 0, 0], [1, 1, 0, 0]], atol=1e-8)
    assert not kept[0, 2] and not kept[0, 3] and not kept[1, 3]


def test_forest_short_cut_and_probabilities(panel):
    rows = L.model_rows(panel.withColumn("two_zeke_time_3", F.lit(True)), OUTCOMES)
    refit = FO.Refit(date(2021, 2, 1), date(2021, 4, 1), date(2021, 5, 5), date(2021, 5, 12))
    got = FO.forest_scores(rows, [refit], OUTCOMES, ["admits_weekly"], n_trees=5).toPandas()
    assert (got[got.outcome_label == "two_zeke_time_3"].pred == 1).all()
    mixed = got[got.outcome_label == "zeke_time_3"]
    assert mixed.pred.dropna().between(0, 1).all()
    # Every area-week of the two test weeks is there; only rows without admissions lack a prediction.
    assert len(mixed) == 60 and (mixed.pred.isna() == mixed.admits_weekly.isna()).all()


def _brute_tree(cells, k, m_of_node, depth):
    """Splits {node: (feature, bin)} and leaf shares of one tree from its cells (bins..., w0, w1), by trying every cut."""
    gini = lambda g: 2 * g[0] * g[1] / (g[0] + g[1]) if g[0] + g[1] > 0 else 0.0
    splits, leaves, at = {}, {}, {1: cells}
    total = lambda part: (sum(r[-2] for r in part), sum(r[-1] for r in part))
    for _ in range(depth):
        after = {}
        for node, part in at.items():
            best = None
            for f in m_of_node(node):
                for cut in sorted({r[f] for r in part})[:-1]:
                    left, right = [r for r in part if r[f] <= cut], [r for r in part if r[f] > cut]
                    gain = gini(total(part)) - gini(total(left)) - gini(total(right))
                    if gain > 1e-9 * sum(total(part)) and (best is None or (round(gain, 12), -f, -cut) > best[0]):
                        best = (round(gain, 12), -f, -cut), left, right
            if best is None:
                after[node] = part
            else:
                splits[node] = (-best[0][1], -best[0][2])
                after[2 * node], after[2 * node + 1] = best[1:]
        at = after
    for node, part in at.items():
        w0, w1 = total(part)
        leaves[node] = w1 / (w0 + w1)
    return splits, leaves


def test_forest_growth_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(w, "o", 2, -1, t, int(rng.integers(0, 6)), int(rng.integers(0, 4)), float(rng.random()), float(rng.random() * (1 + t)))
            for w in range(2) for t in range(1, 4) for _ in range(20)]
    cells = spark.createDataFrame(rows, "window_no int, outcome_label string, m int, left_out int, tree int, bin_0 int, bin_1 int, w0 double, w1 double")
    levels, leaves = FO.grow(cells, 2, 3, seed=1)
    splits = {(r.window_no, r.tree, r.node): (r.split_on, r.split_at) for level in levels for r in level.collect()}
    shares = {(r.window_no, r.tree, r.node): r.p for r in leaves.collect()}
    want_splits, want_leaves = {}, {}
    for w in range(2):
        for t in range(1, 4):
            a, b = _brute_tree([r[5:] for r in rows if r[0] == w and r[4] == t], 2, lambda node: (0, 1), 3)
            want_splits |= {(w, t, n): v for n, v in a.items()}
            want_leaves |= {(w, t, n): v for n, v in b.items()}
    assert splits == want_splits and shares.keys() == want_leaves.keys()
    assert all(abs(shares[key] - v) < 1e-9 for key, v in want_leaves.items())
    # Every row's prediction is the mean over the trees of the leaf that its bins lead to.
    got = {(r.window_no, r.bin_0, r.bin_1): r.p for r in FO.predict(cells.select(*FO.FIT, "bin_0", "bin_1").distinct(), levels, leaves, 2).collect()}
    for (w, *bins), p in got.items():
        walked = []
        for t in range(1, 4):
            node = 1
            while (w, t, node) in splits:
                f, cut = splits[w, t, node]
                node = 2 * node + (bins[f] > cut)
            walked.append(shares[w, t, node])
        assert abs(np.mean(walked) - p) < 1e-9


def test_forest_draws(spark):
    """Draws have mean and variance 1, differ between trees, and weights are summed by label."""
    rows = spark.range(4000).selectExpr("1 AS window_no", "'o' AS outcome_label", "0 AS fold", "CAST(id % 2 AS double) AS y", "2e0 AS w", "xxhash64(id) AS row_hash", "CAST(id AS int) AS bin_0")
    n = FO.training_cells(rows, 1, 2, seed=1).selectExpr("tree", "bin_0", "w0 / 2 AS a", "w1 / 2 AS b").toPandas()
    assert (n[n.bin_0 % 2 == 0].b == 0).all() and (n[n.bin_0 % 2 == 1].a == 0).all()
    for t in (1, 2):
        drawn = n[n.tree == t].set_index("bin_0").eval("a + b").reindex(range(4000), fill_value=0)
        assert abs(drawn.mean() - 1) < 0.06 and abs(drawn.var() - 1) < 0.12
    assert n.groupby("bin_0").size().nunique() > 1


def test_forest_without_refits_or_without_two_labels(panel):
    rows = L.model_rows(panel.withColumn("two_zeke_time_3", F.lit(False)), OUTCOMES)
    refit = FO.Refit(date(2021, 2, 1), date(2021, 4, 1), date(2021, 5, 5), date(2021, 5, 5))
    assert FO.forest_scores(rows, [], OUTCOMES, ["admits_weekly"]).count() == 0
    got = FO.forest_scores(rows, [refit], ["two_zeke_time_3"], ["admits_weekly", "cases_weekly"], n_trees=3, mtry=2).toPandas()
    assert len(got) == 30 and (got.pred == 0).all()  # also rows without admissions


def test_forest_cross_validation_picks_what_predicts(panel):
    """Two features, one of them noise: with both tried at each node the informative one is found, and predictions follow it."""
    rows = L.model_rows(panel, OUTCOMES)
    refits = [FO.Refit(date(2021, 1, 1), date(2021, 4, 20), date(2021, 5, 5), date(2021, 6, 2)), FO.Refit(date(2021, 1, 1), date(2021, 1, 2), date(2021, 6, 9), date(2021, 6, 9))]
    got = FO.forest_scores(rows, refits, OUTCOMES, ["admits_weekly", "cases_weekly"], n_trees=10, mtry=2).toPandas()
    assert len(got) == 6 * 30 * 2 and got[got.ymd == date(2021, 6, 9)].pred.isna().all()  # a window without rows
    first = got[(got.ymd < date(2021, 6, 9)) & (got.outcome_label == "zeke_time_3")]
    assert (first.pred.isna() == first.admits_weekly.isna()).all() and first.pred.dropna().between(0, 1).all()
    assert first.pred.corr(first.admits_weekly) > 0.7


def test_every_date_has_its_own_forest_window(panel):
    """A refit's rows are the quarterly window of each of its dates, no more and no less."""
    windows = T.quarterly_windows(T.eval_dates(panel, "2021-04-01", "2021-07-20"))
    days = panel.select("ymd").distinct()
    want = {}
    for r in T.in_windows(days, windows, 1).collect():
        want.setdefault(r.end_date, set()).add(r.ymd)
    dates = [r.end_date for r in windows.collect()]
    refits = FO.date_refits(windows)
    every = [r.ymd for r in days.collect()]
    for d in dates:
        mine = [r for r in refits if r.first <= d <= r.last]
        assert len(mine) == 1 and {y for y in every if mine[0].lo < y <= mine[0].hi} == want[d]
    assert len(refits) > len({(d.year, (d.month - 1) // 3) for d in dates})  # more than a forest a quarter


def test_forest_query_asks_for_every_outcome_and_date(spark, monkeypatch):
    from riskpanel.operators.rules import DEFAULT_OUTCOMES
    from riskpanel.queries import models as M
    from riskpanel.queries import shared as X

    sf, asked, kept = "/root/testdata/sf0.001", {}, X.stored

    def instead(rows, refits, outcomes, features, **_):
        asked.update(refits=refits, outcomes=outcomes)
        return rows.withColumn("pred", F.lit(None).cast("double"))

    monkeypatch.setattr(M.FO, "forest_scores", instead)
    monkeypatch.setattr(M.X, "stored", lambda spark, name, sf_dir, build: build() if name == "forest_state" else kept(spark, name, sf_dir, build=build))
    rows = M.rf_variant(spark, sf)
    labels = {r.outcome_label for r in rows.select("outcome_label").distinct().collect()}
    assert labels == set(asked["outcomes"]) == set(DEFAULT_OUTCOMES) and len(labels) == 4
    dates = [r.end_date for r in T.eval_dates(X.panel(spark, sf), X.START, X.END).collect()]
    assert all(sum(r.first <= d <= r.last for r in asked["refits"]) == 1 for d in dates)
    assert all((d - r.hi).days >= 21 for r in asked["refits"] for d in dates if r.first <= d <= r.last)
    assert len(asked["refits"]) > 6  # the quarters


def test_matrix_from_cubes_equals_run_by_run(spark, panel):
    from riskpanel.operators import scoring as S
    from riskpanel.plans import matrix as M

    levels = ((2.0, 4.0), (3.0, 6.0), (10.0,))
    runs = [M.Run(1, "base", "H", weeks=4, outcomes=OUTCOMES), M.Run(2, "w8", "CH", weeks=8, outcomes=OUTCOMES), M.Run(10, "0", "", prevalence=True, outcomes=OUTCOMES[:1]),
            M.Run(11, "uw", "H", weeks=4, equal_weight=True, outcomes=OUTCOMES), M.Run(12, "roc", "H", weeks=4, outcomes=OUTCOMES, sweep=True)]
    studies = {"base": STUDY, "late": E.Study("2021-06-01", "2021-07-10", "2021-06-30")}
    both = panel.withColumn("geo", F.lit("all")).unionByName(panel.where("state < 's2'").withColumn("geo", F.lit("some")))
    rows = L.model_rows(both, OUTCOMES)
    fits = L.fit_sets(rows.withColumn("grp", F.col("geo")), T.eval_dates(panel, STUDY.start, STUDY.end), M.fit_sets(runs), ["all", "some"], OUTCOMES).cache()
    scored = L.score(rows, fits.withColumnRenamed("grp", "geo"), on=["geo"]).cache()
    table = M.run_matrix(M.static_cube(both, studies, levels, runs),
                         M.adaptive_cube(scored, studies, [*E.ROC_CUTS, *M.PREFERENCES.values()]), studies, runs).cache()
    columns = ("rule_kind", "var", "outcome_label", "quarter", "mult", "metric", "metric_value")

    def key(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.select(*columns).collect())

    for period, study in studies.items():
        for geo in ("all", "some"):
            own, mine = both.where(F.col("geo") == geo), scored.where(F.col("geo") == geo)
            for r in runs:
                weight = M.WEIGHTS[r.equal_weight]
                pred = mine.where((F.col("weight_name") == weight) & F.col("spec").isin(*[s.name for s in L.DEFAULT_SPECS])).where(F.col("outcome_label").isin(*r.outcomes))
                grid = M.grid_for(r.uses, *levels)
                if r.sweep:
                    want = E.roc_estimates(own, grid, study, pred.where(F.col("weeks").isin(0, r.weeks)), outcomes=r.outcomes)
                else:
                    prefs = E.NO_PREFERENCES if r.prevalence else M.PREFERENCES
                    want = S.with_preferences(S.rule_sums(own, [grid], r.outcomes, study.start, study.end, study.split, weight=weight), prefs)
                    if r.weeks:
                        want = want.unionByName(E.adaptive_metrics(pred, study, prefs, weeks=r.weeks, weight=weight).withColumn("type", F.lit(r.uses)))
                    want = S.to_metric_rows(want)
                got = table.where((F.col("period") == period) & (F.col("geo") == geo) & (F.col("run_number") == r.number))
                assert key(got) == key(want), (period, geo, r.name)


def test_sinks_can_be_run_again(spark, tmp_path):
    from riskpanel.sources import tables as IO

    rows = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("b", "y", 3.0)], "spec string, outcome_label string, pred double")
    for _ in range(2):
        IO.write_predictions(rows, str(tmp_path / "predictions"))
        IO.write_panel(rows, str(tmp_path / "panel"), "state")
        IO.append_results(rows, str(tmp_path / "results"), period="base", level="state")
    IO.write_predictions(rows.where("spec = 'b'").withColumn("pred", F.lit(9.0)), str(tmp_path / "predictions"))  # 'a' stays
    IO.write_panel(rows.limit(1), str(tmp_path / "panel"), "group")
    assert sorted(r.pred for r in IO.read_results(spark, str(tmp_path / "predictions")).collect()) == [1.0, 9.0, 9.0]
    assert IO.read_panel(spark, str(tmp_path / "panel"), "state").count() == 3 and IO.read_panel(spark, str(tmp_path / "panel")).count() == 4
    assert IO.read_results(spark, str(tmp_path / "results")).count() == 3

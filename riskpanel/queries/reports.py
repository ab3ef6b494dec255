"""Result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel.functions.labels import OUTCOME_NAMES, SPEC_NAMES, recode
from riskpanel.operators import logistic as L
from riskpanel.operators import rules as R
from riskpanel.operators import scoring as S
from riskpanel.operators import selection as V
from riskpanel.operators import switches as W
from riskpanel.operators.reshape import stack, to_wide
from riskpanel.operators.synthetic import CUTOFFS, replicate_mean as mean_over_replicates
from riskpanel.plans import estimates as E
from riskpanel.plans import reports as P
from riskpanel.queries import models as M
from riskpanel.queries import query
from riskpanel.queries import shared as X
from riskpanel.session import scratch_path
from riskpanel.sources import tables as IO

QUARTERS = [*X.TRAIN_QUARTERS, *X.TEST_QUARTERS]
_GRIDS = list(X.GRIDS.values())
_OTHERS = ("Community level", "Z", "Prevalence", *M.DEFAULT_NAMES)


def metric_rows(spark, sf_dir, specs=tuple(M.DEFAULT_NAMES)):
    """The stored metric table: static rules of every type, baselines, prevalence and the refitted models."""
    def build():
        p = X.panel(spark, sf_dir)
        static = S.static_metrics(p, _GRIDS, X.START, X.END, X.SPLIT)
        prevalence = P.prevalence_rows(p, M.STUDY, R.DEFAULT_OUTCOMES)
        adaptive = S.to_metric_rows(E.adaptive_metrics(M.scored(spark, sf_dir), M.STUDY)).withColumn("type", F.lit("H"))
        return static.unionByName(prevalence).unionByName(adaptive)

    rows = X.stored(spark, "metric_rows", sf_dir, build=build)
    return rows.where((F.col("rule_kind") != "adaptive") | F.col("var").isin(list(specs)))


_BY = "type, var, kind, outcome_label, quarter, lab, mult"
def metrics_sql(specs=L.DEFAULT_SPECS, level: str = "state") -> str:
    """CTEs that end in ``t`` (the metric table with scores) and ``best``; without specifications only the rules."""
    scored = f"{M.scored_sql(specs)}," if specs else ""
    adaptive = """
  UNION ALL SELECT 'H', spec, 'adaptive', ymd, quarter_label, outcome_label, weight, y,
    CAST(pred >= 1 / (1 + mult) AS DOUBLE), lab, mult FROM scored CROSS JOIN prefs""" if specs else ""
    return f"""WITH {X.panel_sql(level)}, {X.outcomes_sql()}, {scored} {X.PREFS_SQL},
{X.rule_values_sql().replace('valued AS', 'static AS')},
valued AS (
  SELECT type, CASE var WHEN 'cdc_flag' THEN 'Community level' WHEN 'current_zeke' THEN 'Z' ELSE var END AS var,
    CASE WHEN var IN ('cdc_flag', 'current_zeke') THEN 'baseline' ELSE 'static' END AS kind,
    ymd, quarter_label, outcome_label, weight, y, v, lab, mult FROM static CROSS JOIN prefs
  UNION ALL SELECT 'Prev', 'Prevalence', 'prevalence', ymd, quarter_label, outcome_label, weight, y,
    CAST(cases_weekly >= 0 AND admits_weekly >= 0 AND perc_covid_100 >= 0 AS DOUBLE), lab, 1e0
    FROM long CROSS JOIN prefs WHERE {X.IN_RANGE}{adaptive}),
metrics AS MATERIALIZED ({X.confusion_sql(X.PERIODS_SQL, _BY, 'mult')}),
t AS MATERIALIZED (SELECT *, {X.LAB2_SQL} AS lab2, round(w_acc, 9) AS score FROM metrics),
tr AS (SELECT lab, lab2, type, kind, var, score AS training FROM t WHERE quarter = 'Training'),
best AS MATERIALIZED (SELECT *, kind = 'static' AND training = max(training) OVER (PARTITION BY lab, lab2, type, kind)
  AS best FROM tr)"""


METRICS = metrics_sql()
STATIC = metrics_sql(())  # for reports of static rules only


LEVEL_NAMES = {"state": "States", "group": "HSAs", "member": "Counties"}


def static_rows(spark, sf_dir, level):
    """The stored metric table of the static rules and baselines of one geography."""
    return X.stored(spark, f"static_rows_{level}", sf_dir, build=lambda: S.static_metrics(
        X.panel(spark, sf_dir, level), _GRIDS, X.START, X.END, X.SPLIT))


def _by_level(select: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({metrics_sql((), k)} {select.replace('{level}', name)})" for k, name in LEVEL_NAMES.items())


@query("best_static_table", _by_level("""
SELECT '{level}' AS level, lab, lab2, type, var FROM best WHERE best AND lab2 IN ('>1 death/100K/wk', '>2 deaths/100K/wk')"""))
def best_static_table(spark, sf_dir):
    """Best static rule per level, preference, outcome and type, appended level by level to one result dataset."""
    path = scratch_path(spark, "best_static")
    for level, name in LEVEL_NAMES.items():
        rows = static_rows(spark, sf_dir, level).where(F.col("outcome_label").isin(*P.MORTALITY))
        IO.append_results(V.best_static(rows, QUARTERS), path, level=name)
    return IO.read_results(spark, path).select("level", "lab", "lab2", "type", "var")


def _comparison_sql(outcomes, keep):
    names = ", ".join(f"'{OUTCOME_NAMES[o]}'" for o in outcomes)
    return f"""
kept AS MATERIALIZED (SELECT t.lab, t.lab2, CASE WHEN t.kind = 'static' THEN t.type ELSE t.var END AS var, t.quarter AS period,
  CASE WHEN score * 100 < 0 THEN 0 ELSE round_even(score * 100, 0) END AS value
  FROM t JOIN best b ON t.lab = b.lab AND t.lab2 = b.lab2 AND t.type = b.type AND t.kind = b.kind AND t.var = b.var
  WHERE t.lab2 IN ({names}) AND ({keep}))"""


_KEEP = "b.best OR (t.kind <> 'static' AND t.var IN (" + ", ".join(f"'{v}'" for v in _OTHERS) + "))"
_TRAIN = ", ".join(f"'{q}'" for q in X.TRAIN_QUARTERS)
_TEST = ", ".join(f"'{q}'" for q in X.TEST_QUARTERS)


def _regret_sql(keep, outcomes=P.MORTALITY, metrics=METRICS):
    return f"""{metrics}, {_comparison_sql(outcomes, keep)},
r AS (SELECT *, max(value) OVER (PARTITION BY lab, lab2, period) - value AS regret,
  CASE WHEN period IN ({_TRAIN}) THEN 'Training MR' WHEN period IN ({_TEST}) THEN 'Test MR' ELSE period END AS block FROM kept),
m AS (SELECT *, max(regret) OVER (PARTITION BY lab, lab2, var, block) AS max_regret FROM r),
f AS (SELECT * REPLACE (CASE WHEN block LIKE '%MR' THEN max_regret ELSE value END AS value) FROM m
  WHERE block NOT LIKE '%MR' OR regret = max_regret),
g AS (SELECT *, CASE WHEN block LIKE '%MR' THEN 100 - value ELSE value END AS good FROM f)
SELECT lab, lab2, {X.spec_name_sql()} AS var, period, block, value, regret, max_regret, CASE WHEN block LIKE '%Test%' THEN
  round((good - avg(good) OVER w) / nullif(stddev_samp(good) OVER w, 0), 6) END AS fill
FROM g WINDOW w AS (PARTITION BY lab2, block)"""


@query("max_regret", _regret_sql(_KEEP))
def max_regret(spark, sf_dir):
    rows = metric_rows(spark, sf_dir).where(F.col("outcome_label").isin(*P.MORTALITY))
    table = V.comparison_table(rows, QUARTERS, _OTHERS)
    out = P.with_spec_names(V.max_regret(table, X.TRAIN_QUARTERS, X.TEST_QUARTERS))
    return X.rounded(out.select("lab", "lab2", "var", "period", "block", "value", "regret", "max_regret", "fill"))


@query("max_regret_adaptive", _regret_sql("t.kind = 'adaptive'", R.DEFAULT_OUTCOMES, metrics_sql(L.SPECS)))
def max_regret_adaptive(spark, sf_dir):
    """The same comparison among all refitted models, for every outcome."""
    rows = metric_rows(spark, sf_dir, [x.name for x in L.SPECS])
    out = P.with_spec_names(V.max_regret(V.comparison_table(rows, QUARTERS, None), X.TRAIN_QUARTERS, X.TEST_QUARTERS))
    return X.rounded(out.select("lab", "lab2", "var", "period", "block", "value", "regret", "max_regret", "fill"))


@query("quarter_table", f"""{METRICS}, {_comparison_sql(R.DEFAULT_OUTCOMES, _KEEP)}
SELECT lab, lab2, {X.spec_name_sql()} AS var, period, value,
  round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS fill FROM kept WINDOW w AS (PARTITION BY lab, lab2)""")
def quarter_table(spark, sf_dir):
    return X.rounded(P.with_spec_names(V.comparison_table(metric_rows(spark, sf_dir), QUARTERS, _OTHERS)))


_BASELINES = ("Community level", "Z")


@query("level_comparison", _by_level(f""", {_comparison_sql(R.DEFAULT_OUTCOMES, "b.best OR (t.kind = 'baseline')")}
SELECT '{{level}}' AS level, lab, lab2, var, period, value,
  round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS fill FROM kept WINDOW w AS (PARTITION BY lab, lab2)"""))
def level_comparison(spark, sf_dir):
    """The quarter table of static rules and baselines for all geographies at once, grouped by level."""
    rows = stack([static_rows(spark, sf_dir, k).withColumn("level", F.lit(name)) for k, name in LEVEL_NAMES.items()])
    return X.rounded(V.comparison_table(rows, QUARTERS, _BASELINES, group=["level"]))


@query("time_trend_table", METRICS + f""",
k AS (SELECT * FROM t WHERE lab = 'Neutral' AND quarter NOT IN ('Test', 'Overall') AND var <> '0 6 0'),
m AS (SELECT *, max(CASE WHEN quarter = 'Training' THEN score END) OVER (PARTITION BY outcome_label, var) AS training FROM k),
n AS (SELECT *, max(CASE WHEN kind = 'adaptive' THEN training END) OVER (PARTITION BY outcome_label) AS max_training FROM m)
SELECT lab2, outcome_label, quarter, {X.spec_name_sql()} AS var, kind AS rule_kind, training = max_training AS best_ind,
  CASE WHEN training = max_training THEN 'Adaptive' ELSE {X.spec_name_sql()} END AS line,
  CASE WHEN kind = 'static' THEN split_part(var, ' ', 2) END AS h_level,
  round(CASE WHEN kind = 'static' AND score < 0 THEN 0 ELSE score END, 6) AS metric_value
FROM n WHERE quarter <> 'Training' AND type = 'H'""")
def time_trend_table(spark, sf_dir):
    rows = metric_rows(spark, sf_dir).where("type = 'H'")
    trend = V.time_trend(rows, M.DEFAULT_NAMES, hidden=["0 6 0"])
    line = F.when(F.col("best_ind"), F.col("line")).otherwise(recode(F.col("line"), SPEC_NAMES))
    return X.rounded(P.with_spec_names(trend.withColumn("line", line)))


@query("pivot_periods", METRICS + """
SELECT type, var, lab2, lab, max(CASE WHEN quarter = 'Overall' THEN round(percright, 6) END) AS "Overall",
  max(CASE WHEN quarter = 'Training' THEN round(percright, 6) END) AS "Training",
  max(CASE WHEN quarter = 'Test' THEN round(percright, 6) END) AS "Test" FROM t GROUP BY ALL""")
def pivot_periods(spark, sf_dir):
    rows = metric_rows(spark, sf_dir).where("metric = 'Accuracy'")
    return X.rounded(to_wide(rows, ["type", "var", "lab2", "lab"], "quarter", "metric_value", list(V.SIDES)))


@query("arg_best_rule", STATIC + """
SELECT quarter, lab2, round(max(score), 6) AS best_value, arg_min(var, (-score, var)) AS best_var,
  round(min(score), 6) AS worst_value, arg_min(var, (score, var)) AS worst_var
FROM t WHERE lab = 'Neutral' AND type = 'H' AND kind = 'static' GROUP BY ALL""")
def arg_best_rule(spark, sf_dir):
    rows = metric_rows(spark, sf_dir).where(
        "lab = 'Neutral' AND type = 'H' AND rule_kind = 'static' AND metric = 'Weighted accuracy'")
    return X.rounded(V.best_and_worst(rows, ["quarter", "lab2"]))


@query("agg_of_agg", METRICS + """,
p AS (SELECT kind AS rule_kind, lab2, quarter, max(score) AS best, min(score) AS worst FROM t WHERE lab = 'Neutral'
  AND kind IN ('static', 'adaptive', 'prevalence') AND quarter NOT IN ('Training', 'Test', 'Overall') GROUP BY ALL)
SELECT rule_kind, lab2, round(min(best), 6) AS min_best, round(max(best), 6) AS max_best, round(min(worst), 6) AS min_worst,
  count(*) AS n_periods FROM p GROUP BY 1, 2""")
def agg_of_agg(spark, sf_dir):
    """Ranges over the quarters of the best and worst score of static rules, refitted models and prevalence."""
    rows = metric_rows(spark, sf_dir).where(
        "lab = 'Neutral' AND rule_kind IN ('static', 'adaptive', 'prevalence') AND metric = 'Weighted accuracy' "
        "AND quarter NOT IN ('Training', 'Test', 'Overall')")
    return X.rounded(V.range_of_best(rows, ["rule_kind", "lab2"], "quarter", "metric_value"))


_POINTS = "SELECT type, var, outcome_label, sens, spec FROM t WHERE quarter = 'Test' AND lab = 'Neutral' AND type IN ('HO', 'CHO')"


@query("pareto_dominance", STATIC + f""",
p AS MATERIALIZED ({_POINTS})
SELECT a.type, a.outcome_label, a.var, round(a.sens, 6) AS "Sensitivity", round(a.spec, 6) AS "Specificity",
  CAST((SELECT count(*) FROM p b WHERE b.type = a.type AND b.outcome_label = a.outcome_label
    AND round(b.spec, 9) >= round(a.spec, 9) AND round(b.sens, 9) >= round(a.sens, 9)) AS INTEGER) AS chk FROM p a""")
def pareto_dominance(spark, sf_dir):
    rows = metric_rows(spark, sf_dir).where("lab = 'Neutral' AND type IN ('HO', 'CHO')")
    points = V.sens_spec(rows, "Test", ["type", "outcome_label", "var"])
    return X.rounded(V.pareto_counts(points, ["type", "outcome_label"]))


_CHOSEN = {"HO": {"zeke_time_3": "0 2 5", "two_zeke_time_3": "0 4 5"}, "CHO": {"zeke_time_3": "2 2 5", "two_zeke_time_3": "3 4 5"}}
# Cost ratios that the plot leaves out, by outcome.
_BLOCKED = {"zeke_time_3": (15, 1 / 7, 1 / 5, 1 / 10, 1 / 2, 1 / 3, 1 / 20),
            "two_zeke_time_3": (1 / 2, 1 / 3, 15, 1 / 15, 1 / 5, 3, 7, 10, 1 / 10, 1 / 7)}
_PICK = " OR ".join(f"(type = '{k}' AND outcome_label = '{o}' AND var = '{v}')" for k, d in _CHOSEN.items() for o, v in d.items())
_HIDE = " OR ".join(
    f"(outcome_label = '{o}' AND mult IN ({', '.join(f'CAST({float(c)!r} AS DOUBLE)' for c in cs)}))" for o, cs in _BLOCKED.items())


@query("roc_points", M.roc_sql().replace("valued AS", "valued_roc AS").replace("FROM valued)", "FROM valued_roc)") + f""",
{X.rule_values_sql([X.GRIDS['HO'], X.GRIDS['CHO']], fixed=False).replace('grid_rules', 'grid2').replace('valued AS', 'valued2 AS')},
m2 AS ({X.confusion_sql(X.PERIODS_SQL.replace('FROM valued', 'FROM valued2'), 'type, var, outcome_label, quarter')})
SELECT outcome_label, var, round(mult, 6) AS mult, round(sens, 6) AS "Sensitivity", round(spec, 6) AS "Specificity",
  var AS source FROM roc WHERE quarter = 'Test' AND var IN ('Adaptive', 'Community level', 'Z') AND NOT ({_HIDE})
UNION ALL SELECT outcome_label, var, 1e0, round(sens, 6), round(spec, 6), type FROM m2 WHERE quarter = 'Test' AND ({_PICK})""")
def roc_points(spark, sf_dir):
    rows = metric_rows(spark, sf_dir)
    static = {k: (rows.where(F.col("type") == k), chosen) for k, chosen in _CHOSEN.items()}
    roc = M.roc_rows(spark, sf_dir, ["Adaptive"])
    return X.rounded(V.roc_points(roc, static, "Adaptive", _BLOCKED))


_FLAGS = ["cdc_flag", *R.DEFAULT_OUTCOMES]


def _switch_sql(source, flag, name, by="state"):
    return f"""SELECT '{name}' AS flag, unnest(['chg', 'chg2']) AS var, unnest([
  count(*) FILTER (WHERE now <> before), count(*) FILTER (WHERE now = after AND now <> before)]) AS tot
  FROM (SELECT {flag} AS now, lag({flag}) OVER w AS before, lead({flag}) OVER w AS after FROM {source}
  WINDOW w AS (PARTITION BY {by} ORDER BY ymd))"""


@query("switch_counts", f"WITH {X.panel_sql('member')} " + " UNION ALL ".join(_switch_sql("panel", f, f) for f in _FLAGS))
def switch_counts(spark, sf_dir):
    return W.switch_totals(X.panel(spark, sf_dir, "member"), _FLAGS)


# Per level: what predicts deaths, and what predicts beds.
_PAIRS = {"state": ("Adaptive", "Adaptive: CHOD"), "member": ("Adaptive: CHOZ", "Adaptive: CHOD")}


def _predicted_sql(level: str) -> str:
    """CTEs (with WITH) that end in ``predicted``."""
    deaths, beds = _PAIRS[level]
    return f"""WITH {X.panel_sql(level)}, {X.outcomes_sql()}, {M.scored_sql([L.spec(deaths), L.spec(beds)], None if level == 'state' else L.ALIAS_TOL)},
predicted AS MATERIALIZED (SELECT state, ymd, outcome_label, pred >= 0.5 AS value, y FROM scored WHERE
  (outcome_label IN ('zeke_time_3', 'two_zeke_time_3') AND spec = '{deaths}') OR
  (outcome_label IN ('icu_2_time_3', 'perc_covid_10_time_3') AND spec = '{beds}'))"""


def _summary_sql(level: str) -> str:
    mine = " UNION ALL ".join(_switch_sql(f"(SELECT * FROM predicted WHERE outcome_label = '{o}')", "value", o) for o in R.DEFAULT_OUTCOMES)
    return f"""SELECT * FROM ({_predicted_sql(level)}, a AS ({mine}), b AS ({' UNION ALL '.join(_switch_sql('panel', f, f) for f in _FLAGS)})
SELECT '{LEVEL_NAMES[level]}' AS level, coalesce(a.flag, b.flag) AS outcome_label, coalesce(a.var, b.var) AS var, a.tot AS tot_predicted, b.tot AS tot_true,
  (SELECT tot FROM b c WHERE c.flag = 'cdc_flag' AND c.var = coalesce(a.var, b.var)) AS "CL"
FROM a FULL JOIN b ON a.flag = b.flag AND a.var = b.var WHERE coalesce(a.flag, b.flag) <> 'cdc_flag')"""


@query("switch_summary", " UNION ALL ".join(map(_summary_sql, _PAIRS)))
def switch_summary(spark, sf_dir):
    """Switches of states and of counties, each from the stored predictions of its own pair of specifications."""
    levels = []
    for level, pair in _PAIRS.items():
        calendar = P.predicted_calendar(M.predictions(spark, sf_dir, level), *pair)
        rows = W.switch_summary(calendar, X.panel(spark, sf_dir, level), R.DEFAULT_OUTCOMES)
        levels.append(rows.withColumn("level", F.lit(LEVEL_NAMES[level])))
    return stack(levels)


@query("prediction_calendar", f"""{_predicted_sql('state')}
SELECT state, ymd, outcome_label, {X.LAB2_SQL} AS lab2, value, CAST(y AS BOOLEAN) AS happened FROM predicted""")
def prediction_calendar(spark, sf_dir):
    """Predicted class and actual outcome per area and week, deaths from one specification and beds from another, out of the stored predictions."""
    return P.predicted_calendar(M.predictions(spark, sf_dir), *_PAIRS["state"])


_BANDS_SQL = f"""bands AS MATERIALIZED (SELECT state, ymd, POPESTIMATE2019, deaths_weekly,
  CASE WHEN two_zeke_time_3 THEN '>2 deaths/100K/week' WHEN zeke_time_3 THEN '1-2 deaths/100K/week'
    WHEN NOT zeke_time_3 THEN '<1 death/100K/week' END AS band,
  unnest(['Cases/100K', 'Hospital admissions/100K', 'Percent bed occupancy']) AS var2,
  unnest([cases_weekly, admits_weekly, perc_covid_100]) AS value FROM panel WHERE {X.IN_RANGE})"""


@query("quartiles_by_band", f"""WITH {X.panel_sql('member')}, {_BANDS_SQL},
q AS (SELECT ymd, var2, band, count(*) AS n, CASE WHEN count(value) = count(*) THEN quantile_cont(value, 0.5) END AS med,
  CASE WHEN count(value) = count(*) THEN quantile_cont(value, 0.25) END AS q25,
  CASE WHEN count(value) = count(*) THEN quantile_cont(value, 0.75) END AS q75 FROM bands GROUP BY ALL)
SELECT ymd, var2, band, round(med, 6) AS med, round(q25, 6) AS q25, round(q75, 6) AS q75, n,
  round(n * 1e0 / sum(n) OVER (PARTITION BY ymd, var2) * 100, 6) AS perc FROM q""")
def quartiles_by_band(spark, sf_dir):
    return X.rounded(P.band_quartiles(X.panel(spark, sf_dir, "member"), M.STUDY))


@query("loglog_extract", f"""WITH {X.panel_sql('group')}, {_BANDS_SQL}
SELECT state, ymd, var2, band, year(ymd) || '-' || quarter(ymd) AS quarter,
  round(CASE WHEN value > 0 THEN ln(value) END, 6) AS log_value,
  round(CASE WHEN deaths_weekly > 0 THEN ln(deaths_weekly) END, 6) AS log_deaths FROM bands WHERE POPESTIMATE2019 > 11""")
def loglog_extract(spark, sf_dir):
    return X.rounded(P.loglog_points(X.panel(spark, sf_dir, "group"), M.STUDY, 11))


_CUT_SQL = ["5e0", "10e0", "5e0 + 10e0 * (r - 1) / (n - 1)", "5 + 10 / (1 + exp(-0.3e0 * (r - 40)))",
            "(20 - 0.01e0 * pow(r - 25, 2) + 10) / 2",
            "5 + 10 / (1 + exp(-0.3e0 * (r - 25))) - 5 / (1 + exp(-0.4e0 * (r - 45)))"]


@query("replicate_mean", f"""WITH {X.panel_sql('group')},
d AS (SELECT ymd, row_number() OVER (ORDER BY ymd) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT ymd FROM panel)),
o AS (SELECT p.*, split_part(state, '-', 2) AS sim, {', '.join(
    f"CAST(1 / (1 + exp(-3 * (admits_weekly - ({c})))) >= 0.5 AS DOUBLE) AS cutoff{i}" for i, c in enumerate(_CUT_SQL, 1))}
  FROM panel p JOIN d ON p.ymd = d.ymd),
g AS (SELECT *, {', '.join(f"lag({c}, 3) OVER (PARTITION BY state ORDER BY ymd) AS lag_{c}" for c in CUTOFFS)} FROM o),
long AS (SELECT * REPLACE (weight_alt AS weight), unnest([{', '.join(f"'{c}'" for c in CUTOFFS)}]) AS outcome_label,
  unnest([{', '.join(CUTOFFS)}]) AS y, unnest([{', '.join('lag_' + c for c in CUTOFFS)}]) AS lagged FROM g WHERE {X.IN_RANGE}),
valued AS (SELECT sim, ymd, quarter_label, outcome_label, weight, y, '0 ' || a || ' 0' AS var,
    CAST(cases_weekly >= 0 AND admits_weekly >= a AND perc_covid_100 >= 0 AS DOUBLE) AS v
    FROM long CROSS JOIN (VALUES (2), (4), (6)) AS l(a)
  UNION ALL SELECT sim, ymd, quarter_label, outcome_label, weight, y, 'Z', lagged FROM long
  UNION ALL SELECT sim, ymd, quarter_label, outcome_label, weight, y, 'Community level', CAST(cdc_flag AS DOUBLE) FROM long),
m AS ({X.confusion_sql(X.PERIODS_SQL, 'sim, var, outcome_label, quarter')})
SELECT var, outcome_label, quarter, round(avg(w_acc), 6) AS metric_value FROM m GROUP BY ALL""")
def replicate_mean(spark, sf_dir):
    """Synthetic outcomes evaluated within each replicate (market segment), then averaged over replicates."""
    ids = ["state", "ymd", "sim", "weight_alt", "cases_weekly", "admits_weekly", "perc_covid_100", "cdc_flag"]
    panel = X.panel(spark, sf_dir, "group").withColumn("sim", F.split_part("state", F.lit("-"), F.lit(2)))
    synthetic = P.synthetic_outcomes(panel, ids)
    sums = S.rule_sums(synthetic, [X.GRIDS["H"]], CUTOFFS, X.START, X.END, X.SPLIT, weight="weight_alt", by=["sim"])
    rows = S.to_metric_rows(S.rates(sums)).where("metric = 'Weighted accuracy'")
    results = rows.select("sim", "var", "outcome_label", "quarter", "metric_value")
    return X.rounded(mean_over_replicates(results, "sim"))

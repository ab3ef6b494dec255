"""Rule frames and confusion matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel.functions.dates import quarter_label
from riskpanel.operators import rules as R
from riskpanel.operators import scoring as S
from riskpanel.queries import query
from riskpanel.queries import shared as X

_GRID = X.GRIDS["CHO"]
_METRICS = X.rounded_sql(X.METRIC_COLUMNS)


@query("confusion_weighted", f"""WITH {X.panel_sql()}, {X.outcomes_sql()}, {X.rule_values_sql([_GRID], True, 'CHO')},
m AS ({X.confusion_sql(X.PERIODS_SQL, 'type, var, outcome_label, quarter')})
SELECT type, var, outcome_label, quarter, n, {_METRICS} FROM m""")
def confusion_weighted(spark, sf_dir):
    sums = S.rule_sums(X.panel(spark, sf_dir), [_GRID], R.DEFAULT_OUTCOMES, X.START, X.END, X.SPLIT)
    return X.rounded(S.rates(sums).drop("rule_kind"))


@query("weighted_accuracy", f"""WITH {X.panel_sql()}, {X.outcomes_sql()},
flagged AS (SELECT *, CAST(cdc_flag AS DOUBLE) AS v FROM long),
m1 AS ({X.confusion_sql('flagged', 'outcome_label')}),
m2 AS ({X.confusion_sql('flagged', 'outcome_label', '2e0')}),
m3 AS ({X.confusion_sql('flagged', 'outcome_label', '0.5e0')})
SELECT outcome_label, lab, n, round(fn, 6) AS fn, round(fp, 6) AS fp, round(w_acc, 6) AS w_acc FROM (
  SELECT 'Neutral' AS lab, * FROM m1 UNION ALL SELECT 'Better safe than sorry (0.5x FP)', * FROM m2
  UNION ALL SELECT 'Don''t cry wolf (0.5x FN)', * FROM m3)""")
def weighted_accuracy(spark, sf_dir):
    long = R.with_outcomes(X.panel(spark, sf_dir)).withColumn("value", F.col("cdc_flag"))
    out = S.with_preferences(S.confusion_sums(long, ["outcome_label"]))
    return X.rounded(out.select("outcome_label", "lab", "n", "fn", "fp", "w_acc"))


@query("metrics_by_period", f"""WITH {X.panel_sql()}, {X.outcomes_sql()},
valued AS (SELECT ymd, quarter_label, outcome_label, weight, y, CAST(cdc_flag AS DOUBLE) AS v, 'cdc_flag' AS var
  FROM long WHERE {X.IN_RANGE}),
m AS ({X.confusion_sql(X.PERIODS_SQL, 'quarter, var, outcome_label')})
SELECT quarter, var, outcome_label, n, {_METRICS} FROM m""")
def metrics_by_period(spark, sf_dir):
    long = R.with_outcomes(X.panel(spark, sf_dir)).withColumns(
        {"value": F.col("cdc_flag"), "var": F.lit("cdc_flag")}
    )
    return X.rounded(S.period_metrics(long, ["var", "outcome_label"], X.START, X.END, X.SPLIT))


@query("metrics_by_month", f"""WITH {X.panel_sql('group')}, {X.outcomes_sql()},
valued AS (SELECT CAST(date_trunc('month', ymd) AS DATE) AS month, split_part(state, '-', 2) AS segment, outcome_label, weight, y,
  CAST(cdc_flag AS DOUBLE) AS v FROM long WHERE {X.IN_RANGE}),
m AS ({X.confusion_sql('valued', 'month, segment, outcome_label')})
SELECT month, segment, outcome_label, n, {X.rounded_sql(X.METRIC_COLUMNS, 4)} FROM m""")
def metrics_by_month(spark, sf_dir):
    """Metrics in groups of the caller's choice: here calendar months and market segments of the group panel."""
    long = R.with_outcomes(X.panel(spark, sf_dir, "group").where(F.col("ymd").between(X.START, X.END))).withColumns({
        "value": F.col("cdc_flag"), "month": F.trunc("ymd", "month"), "segment": F.split_part("state", F.lit("-"), F.lit(2))})
    return X.rounded(S.confusion_metrics(long, ["month", "segment", "outcome_label"]), 4)


@query("threshold_grid_rules", f"""WITH {X.panel_sql('member')}, {X.grid_sql([_GRID])}
SELECT quarter_label, var, c AS case_levels, a AS admit_levels, p AS perc_levels, count(*) AS n,
  count(*) FILTER (WHERE v) AS n_true, count(*) FILTER (WHERE NOT v) AS n_false,
  count(*) FILTER (WHERE v IS NULL) AS n_unknown
FROM (SELECT *, cases_weekly >= c AND admits_weekly >= a AND perc_covid_100 >= p AS v FROM panel CROSS JOIN grid_rules)
GROUP BY ALL""")
def threshold_grid_rules(spark, sf_dir):
    """How often each rule of the grid holds, by quarter, over the member panel."""
    return R.rule_counts(X.panel(spark, sf_dir, "member"), _GRID, {"quarter_label": quarter_label(F.col("ymd"))})


@query("define_metrics", f"""WITH {X.panel_sql()}, {X.outcomes_sql()}, {X.grid_sql([_GRID])},
r AS (SELECT state, ymd, outcome_label, y, z_cov, 'rule' AS rule_kind, var, c, a, p,
    CAST(cases_weekly >= c AND admits_weekly >= a AND perc_covid_100 >= p AS DOUBLE) AS v
  FROM long CROSS JOIN grid_rules
  UNION ALL SELECT state, ymd, outcome_label, y, z_cov, 'community', 'cdc_flag', NULL, NULL, NULL,
    CAST(cdc_flag AS DOUBLE) FROM long
  UNION ALL SELECT state, ymd, outcome_label, y, z_cov, 'current', 'current_zeke', NULL, NULL, NULL, z_rule FROM long)
SELECT state, ymd, outcome_label, y AS outcome_value, z_cov AS current_zeke, rule_kind, var, c AS case_levels,
  a AS admit_levels, p AS perc_levels, v AS value FROM r WHERE {X.IN_RANGE}""")
def define_metrics(spark, sf_dir):
    grid = R.Grid(_GRID.case, _GRID.admit, _GRID.perc)
    frame = R.define_metrics(X.panel(spark, sf_dir).where(F.col("ymd").between(X.START, X.END)), grid)
    return frame.select("state", "ymd", "outcome_label", "outcome_value", "current_zeke", "rule_kind", "var",
                        "case_levels", "admit_levels", "perc_levels", "value")


@query("current_state_flag", f"""WITH {X.panel_sql('member')}, {X.outcomes_sql()}
SELECT outcome_label, z_rule, z_cov, count(*) AS n FROM long GROUP BY ALL""")
def current_state_flag(spark, sf_dir):
    long = R.with_outcomes(X.panel(spark, sf_dir, "member"))
    return long.groupBy("outcome_label", "z_rule", "z_cov").agg(F.count(F.lit(1)).alias("n"))


@query("community_level_flag", f"""WITH {X.panel_sql('member')}
SELECT quarter_label, cdc_flag_1, cdc_flag_2, cdc_flag, count(*) AS n FROM panel GROUP BY ALL""")
def community_level_flag(spark, sf_dir):
    p = X.panel(spark, sf_dir, "member").withColumn("quarter_label", quarter_label(F.col("ymd")))
    return p.groupBy("quarter_label", "cdc_flag_1", "cdc_flag_2", "cdc_flag").agg(F.count(F.lit(1)).alias("n"))


_PREFS_GRIDS = [X.GRIDS["H"], X.PREVALENCE]


@query("preference_sets", X.metrics_long_sql(_PREFS_GRIDS) + """
SELECT type, var, outcome_label, lab2, quarter, lab, metric, round(metric_value, 6) AS metric_value FROM (
  SELECT *, unnest(['Accuracy', 'Weighted accuracy', 'PPV', 'NPV', 'Sensitivity', 'Specificity']) AS metric,
    unnest([percright, w_acc, ppv, npv, sens, spec]) AS metric_value FROM metric_rows)""")
def preference_sets(spark, sf_dir):
    """All six metrics for the three preference sets, one data pass."""
    rows = S.static_metrics(X.panel(spark, sf_dir), _PREFS_GRIDS, X.START, X.END, X.SPLIT)
    return X.rounded(rows.select("type", "var", "outcome_label", "lab2", "quarter", "lab", "metric", "metric_value"))

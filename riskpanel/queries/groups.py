"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel.functions.dates import quarter_label
from riskpanel.operators import aggregates as A
from riskpanel.operators import quality as Q
from riskpanel.operators.reshape import to_long
from riskpanel.queries import query
from riskpanel.queries import shared as X
from riskpanel.sources.commerce import table

def _n():
    return F.count(F.lit(1)).alias("n")

_MEASURES = ["cases_weekly", "admits_weekly", "icu_weekly", "perc_covid_100", "deaths_weekly"]


def _long_sql(cols, source="panel", ids="state, ymd"):
    return " UNION ALL ".join(f"SELECT {ids}, '{c}' AS var, CAST({c} AS DOUBLE) AS value FROM {source}" for c in cols)


@query("agg_group_sum", f"""WITH {X.facts_sql('member')}
SELECT split_part(state, '-', 1) AS area, split_part(state, '-', 2) AS segment, ymd, count(*) AS n,
  round(coalesce(sum(admits_weekly), 0), 6) AS admits, round(coalesce(sum(icu_weekly), 0), 6) AS icu FROM facts GROUP BY ALL""")
def agg_group_sum(spark, sf_dir):
    """Members summed to their group: missing values are skipped and an all-missing group is 0."""
    part = lambda i: F.split_part("state", F.lit("-"), F.lit(i))
    return X.rounded(X.panel(spark, sf_dir, "member").groupBy(part(1).alias("area"), part(2).alias("segment"), "ymd").agg(
        _n(), A.sum_present("admits_weekly").alias("admits"), A.sum_present("icu_weekly").alias("icu")))


@query("null_profile", f"""WITH {X.panel_sql('member')}, l AS ({_long_sql(_MEASURES)})
SELECT var, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_missing,
  round(avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END), 6) AS share_missing, round(min(value), 6) AS min_value,
  round(max(value), 6) AS max_value, round(avg(value), 6) AS mean_value FROM l GROUP BY 1""")
def null_profile(spark, sf_dir):
    return X.rounded(A.variable_profile(X.panel(spark, sf_dir, "member"), _MEASURES))


@query("agg_min_max_mean", f"""WITH {X.panel_sql('group')} SELECT state, min(ymd) AS first_date, max(ymd) AS last_date,
  round(min(cases_weekly), 6) AS min_cases, round(max(cases_weekly), 6) AS max_cases, round(avg(cases_weekly), 6) AS mean_cases,
  round(avg(admits_weekly), 6) AS mean_admits FROM panel GROUP BY 1""")
def agg_min_max_mean(spark, sf_dir):
    return X.rounded(X.panel(spark, sf_dir, "group").groupBy("state").agg(
        F.min("ymd").alias("first_date"), F.max("ymd").alias("last_date"), F.min("cases_weekly").alias("min_cases"),
        F.max("cases_weekly").alias("max_cases"), F.avg("cases_weekly").alias("mean_cases"),
        F.avg("admits_weekly").alias("mean_admits")))


@query("agg_first_value", """SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority,
  arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_price, count(*) AS n FROM orders GROUP BY 1""")
def agg_first_value(spark, sf_dir):
    order = ["o_orderdate", "o_orderkey"]
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        A.first_by("o_orderpriority", order).alias("first_priority"), A.first_by("o_totalprice", order).alias("first_price"), _n())


@query("duplicate_keys", """SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events
  GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), "event_type")
    return A.duplicate_keys(e, ["user_id", "day", "event_type"])


@query("panel_completeness", """WITH d AS (SELECT c_nationkey, c_mktsegment, CAST(o_orderdate AS DATE) AS ymd, count(*) AS k
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
a AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM d GROUP BY ALL)
SELECT count(*) AS n_areas, min(n) AS min_rows, max(n) AS max_rows FROM a""")
def panel_completeness(spark, sf_dir):
    from riskpanel.sources.commerce import rolled_orders

    return A.panel_completeness(rolled_orders(spark, sf_dir, "group", lambda d: d), "area")


@query("weighted_mean", f"""WITH {X.panel_sql('group')} SELECT ymd,
  round(sum(cases_weekly * weight) / sum(weight), 6) AS cases,
  round(sum(admits_weekly * weight) / nullif(sum(CASE WHEN admits_weekly IS NOT NULL THEN weight END), 0), 6) AS admits,
  round(sum(CAST(zeke_time_3 AS INTEGER) * weight) / nullif(sum(CASE WHEN zeke_time_3 IS NOT NULL THEN weight END), 0), 6)
  AS severe FROM panel GROUP BY 1""")
def weighted_mean(spark, sf_dir):
    return X.rounded(X.panel(spark, sf_dir, "group").groupBy("ymd").agg(
        A.weighted_mean("cases_weekly", "weight").alias("cases"), A.weighted_mean("admits_weekly", "weight").alias("admits"),
        A.weighted_mean(F.col("zeke_time_3").cast("double"), "weight").alias("severe")))


@query("count_if_share", f"""WITH {X.panel_sql('member')} SELECT ymd, count(*) AS n,
  count(*) FILTER (WHERE cases_weekly > 3) AS n_high, round(avg(CAST(zeke_time_3 AS INTEGER)), 6) AS share_severe,
  round(avg(CAST(admits_weekly > 2 AS INTEGER)), 6) AS share_admits FROM panel GROUP BY 1""")
def count_if_share(spark, sf_dir):
    return X.rounded(X.panel(spark, sf_dir, "member").groupBy("ymd").agg(
        _n(), F.count_if(F.col("cases_weekly") > 3).alias("n_high"), A.share_true(F.col("zeke_time_3")).alias("share_severe"),
        A.share_true(F.col("admits_weekly") > 2).alias("share_admits")))


@query("lag_consistency", f"""WITH {X.panel_sql('group')},
a AS (SELECT ymd, deaths_weekly = lead(deaths_now_weekly, 3) OVER (PARTITION BY state ORDER BY ymd) AS agree FROM panel)
SELECT ymd, count(agree) AS n_compared, round(avg(CAST(agree AS INTEGER)), 6) AS share_equal FROM a GROUP BY 1""")
def lag_consistency(spark, sf_dir):
    """The stored lead against the series itself, for every date."""
    return X.rounded(Q.lag_consistency(X.panel(spark, sf_dir, "group"), "deaths_weekly", "deaths_now_weekly", 3))


@query("rolling_mean_check", f"""WITH {X.facts_sql('group')}, r AS (SELECT state, icu_weekly AS x,
  row_number() OVER w - 1 AS r, CASE WHEN count(*) OVER f = 7 THEN avg(icu_weekly) OVER f END AS rolled FROM facts
  WINDOW w AS (PARTITION BY state ORDER BY ymd), f AS (PARTITION BY state ORDER BY ymd ROWS 6 PRECEDING)),
b AS (SELECT state, r // 7 AS block, count(*) AS n, avg(x) AS plain, max(CASE WHEN r % 7 = 6 THEN rolled END) AS rolled
  FROM r GROUP BY ALL)
SELECT state, count(*) AS n_blocks, count(*) FILTER (WHERE abs(plain - rolled) < 1e-9) AS n_equal FROM b WHERE n = 7
GROUP BY 1""")
def rolling_mean_check(spark, sf_dir):
    """Rolling mean of seven rows against the plain mean of the same rows, for every block of seven weeks."""
    return Q.rolling_mean_check(X.panel(spark, sf_dir, "group"), "icu_weekly", 7)


@query("unpivot_outcomes", f"""WITH {X.panel_sql('group')}, l AS ({_long_sql(['zeke_time_3', 'two_zeke_time_3', 'icu_2_time_3',
  'perc_covid_10_time_3'])}) SELECT var AS outcome_label, year(ymd) || ' ' || quarter(ymd) AS quarter, value AS outcome_value,
  count(*) AS n FROM l GROUP BY ALL""")
def unpivot_outcomes(spark, sf_dir):
    outcomes = ["zeke_time_3", "two_zeke_time_3", "icu_2_time_3", "perc_covid_10_time_3"]
    p = X.panel(spark, sf_dir, "group").select("state", "ymd", *[F.col(o).cast("double").alias(o) for o in outcomes])
    long = to_long(p, ["state", "ymd"], outcomes, "outcome_label", "outcome_value")
    return long.groupBy("outcome_label", quarter_label(F.col("ymd")).alias("quarter"), "outcome_value").agg(_n())


@query("dq_report", f"""WITH {X.panel_sql('member')}, l AS ({_long_sql(_MEASURES)}),
a AS (SELECT state, count(*) AS n FROM panel GROUP BY 1),
p AS (SELECT var, count(*) FILTER (WHERE value IS NULL) AS n_missing,
  avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END) AS share_missing, min(value) AS min_value, max(value) AS max_value
  FROM l GROUP BY 1),
g AS (SELECT ymd - lag(ymd) OVER (PARTITION BY state ORDER BY ymd) AS gap FROM panel),
e AS (SELECT deaths_weekly = lead(deaths_now_weekly, 3) OVER (PARTITION BY state ORDER BY ymd) AS agree FROM panel),
m AS (SELECT state, icu_weekly AS x, row_number() OVER w - 1 AS r, CASE WHEN count(*) OVER f = 7 THEN avg(icu_weekly) OVER f END AS rolled FROM panel
  WINDOW w AS (PARTITION BY state ORDER BY ymd), f AS (PARTITION BY state ORDER BY ymd ROWS 6 PRECEDING)),
b AS (SELECT count(*) AS n, avg(x) AS plain, max(CASE WHEN r % 7 = 6 THEN rolled END) AS rolled FROM m GROUP BY state, r // 7),
u AS (SELECT 'duplicate_keys' AS "check", 'panel' AS subject, CAST(count(*) AS DOUBLE) AS value
    FROM (SELECT 1 FROM panel GROUP BY state, ymd HAVING count(*) > 1)
  UNION ALL SELECT 'completeness', 'n_areas', count(*) FROM a UNION ALL SELECT 'completeness', 'min_rows', min(n) FROM a
  UNION ALL SELECT 'completeness', 'max_rows', max(n) FROM a
  UNION ALL SELECT 'profile_n_missing', var, n_missing FROM p UNION ALL SELECT 'profile_share_missing', var, share_missing FROM p
  UNION ALL SELECT 'profile_min_value', var, min_value FROM p UNION ALL SELECT 'profile_max_value', var, max_value FROM p
  UNION ALL SELECT 'days_between_rows', CAST(gap AS VARCHAR), count(*) FROM g WHERE gap IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'lag_n_compared', 'deaths_weekly', count(agree) FROM e UNION ALL SELECT 'lag_n_equal', 'deaths_weekly', count(*) FILTER (WHERE agree) FROM e
  UNION ALL SELECT 'rolling_n_blocks', 'icu_weekly', count(*) FROM b WHERE n = 7
  UNION ALL SELECT 'rolling_n_equal', 'icu_weekly', count(*) FILTER (WHERE abs(plain - rolled) < 1e-9) FROM b WHERE n = 7)
SELECT "check", subject, round(value, 6) AS value FROM u""")
def dq_report(spark, sf_dir):
    """All checks of the member panel as rows; the profile was counted while the panel was written."""
    return X.rounded(Q.dq_report(
        X.panel(spark, sf_dir, "member"), X.WATCHED, seen=X.panel_counts(spark, sf_dir, "member"),
        leads={"deaths_weekly": ("deaths_now_weekly", 3)}, means={"icu_weekly": 7}))

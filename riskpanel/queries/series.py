"""Window columns over area series, weights, ranks and within-group scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskpanel.functions import series as S
from riskpanel.operators import aggregates as A
from riskpanel.operators import ranking as RK
from riskpanel.queries import query
from riskpanel.queries import shared as X
from riskpanel.sources.commerce import populations


@query("lead_outcomes", f"""WITH {X.panel_sql('member')}
SELECT state, ymd, round(deaths_weekly, 6) AS deaths_weekly, half_zeke_time_3, zeke_time_3, two_zeke_time_3, icu_2_time_3,
  perc_covid_10_time_3, round((deaths_weekly + lag(deaths_weekly) OVER (PARTITION BY state ORDER BY ymd)) / 2 * 2, 6) AS deaths_14d
FROM panel""")
def lead_outcomes(spark, sf_dir):
    """Outcome labels three weeks ahead; an unknown future stays unknown."""
    w = S.by_area()
    p = X.panel(spark, sf_dir, "member")
    two_weeks = S.rolling_mean("deaths_weekly", 2, w, skip_null=False) * 2
    return X.rounded(p.select("state", "ymd", "deaths_weekly", "half_zeke_time_3", "zeke_time_3", "two_zeke_time_3",
                              "icu_2_time_3", "perc_covid_10_time_3", two_weeks.alias("deaths_14d")))


@query("lag_features", f"""WITH {X.panel_sql('member')}
SELECT state, ymd, round(lag(cases_weekly, 3) OVER w, 6) AS cases_lag_3, round(lag(admits_weekly, 1) OVER w, 6) AS admits_1_ago,
  round(lag(admits_weekly, 4) OVER w, 6) AS admits_4_ago, round(lead(admits_weekly, 1) OVER w, 6) AS admits_next,
  round(change_admits, 6) AS change_admits, round(change_perc, 6) AS change_perc, round(change_cases, 6) AS change_cases
FROM panel WINDOW w AS (PARTITION BY state ORDER BY ymd)""")
def lag_features(spark, sf_dir):
    w = S.by_area()
    return X.rounded(X.panel(spark, sf_dir, "member").select(
        "state", "ymd", S.behind("cases_weekly", 3, w).alias("cases_lag_3"), S.behind("admits_weekly", 1, w).alias("admits_1_ago"),
        S.behind("admits_weekly", 4, w).alias("admits_4_ago"), S.ahead("admits_weekly", 1, w).alias("admits_next"),
        "change_admits", "change_perc", "change_cases"))


def _roll_sql(c, k, strict):
    frame = f"OVER (PARTITION BY state ORDER BY ymd ROWS {k - 1} PRECEDING)"
    full = f"count(*) {frame} = {k}" + (f" AND count({c}) {frame} = {k}" if strict else "")
    return f"CASE WHEN {full} THEN round(avg({c}) {frame}, 6) END"


@query("rolling_mean_k", f"""WITH {X.facts_sql('member')} SELECT state, ymd, {_roll_sql('admits_weekly', 7, False)} AS mean_present,
  {_roll_sql('admits_weekly', 7, True)} AS mean_complete, {_roll_sql('cases_weekly', 2, False)} AS mean_2 FROM facts""")
def rolling_mean_k(spark, sf_dir):
    w = S.by_area()
    return X.rounded(X.panel(spark, sf_dir, "member").select(
        "state", "ymd", S.rolling_mean("admits_weekly", 7, w).alias("mean_present"),
        S.rolling_mean("admits_weekly", 7, w, skip_null=False).alias("mean_complete"),
        S.rolling_mean("cases_weekly", 2, w).alias("mean_2")))


@query("date_weights", f"""WITH {X.panel_sql('member')} SELECT state, ymd, round(weight, 9) AS weight,
  round(weight_alt, 9) AS weight_alt FROM panel""")
def date_weights(spark, sf_dir):
    p = X.panel(spark, sf_dir, "member").drop("weight", "weight_alt")
    return X.rounded(A.date_weights(p).select("state", "ymd", "weight", "weight_alt"), 9)


@query("rank_avg_ties", f"""WITH pop AS (SELECT {X.AREA_SQL['member']} AS area, count(*) AS population FROM customer GROUP BY 1)
SELECT area, population, rank() OVER (ORDER BY population DESC) + (count(*) OVER (PARTITION BY population) - 1) / 2e0
  AS population_rank FROM pop""")
def rank_avg_ties(spark, sf_dir):
    return RK.rank_average_ties(populations(spark, sf_dir, "member"), "population", "population_rank")


@query("row_number_group", f"""WITH {X.facts_sql('member')} SELECT state, ymd, CAST(row_number() OVER (PARTITION BY state
  ORDER BY ymd) AS INTEGER) AS r, count(*) OVER (PARTITION BY state) AS n FROM facts""")
def row_number_group(spark, sf_dir):
    """Position within an area's series and the series' length; a series is bounded by the study's dates."""
    w = Window.partitionBy("state")
    return X.panel(spark, sf_dir, "member").select(
        "state", "ymd", F.row_number().over(w.orderBy("ymd")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))


@query("zscore_group", f"""WITH {X.facts_sql('group')} SELECT state, ymd, round((icu_weekly - avg(icu_weekly) OVER w) /
  nullif(stddev_samp(icu_weekly) OVER w, 0), 6) AS z FROM facts WINDOW w AS (PARTITION BY ymd)""")
def zscore_group(spark, sf_dir):
    p = X.panel(spark, sf_dir, "group").select("state", "ymd", "icu_weekly")
    return X.rounded(A.group_zscore(p, "icu_weekly", ["ymd"], "z").select("state", "ymd", "z"))

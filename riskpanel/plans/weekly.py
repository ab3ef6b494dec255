"""From weekly rates to the labelled weekly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.conditions import community_level_parts
from riskpanel.functions.dates import epi_week, year_week
from riskpanel.functions.series import ahead, by_area, change
from riskpanel.operators.aggregates import date_weights


def label_weekly(facts: DataFrame, lead_weeks: int = 3, **level_cuts) -> DataFrame:
    """Adds outcome labels ``lead_weeks`` ahead, week-over-week changes, the published level and weights.

    One shuffle by area serves every lead and lag.
    """
    w = by_area()
    deaths = ahead("deaths_now_weekly", lead_weeks, w)
    above, below = community_level_parts(
        F.col("cases_weekly") / 7, F.col("admits_weekly") / 7, F.col("perc_covid_100") / 100, **level_cuts
    )
    labelled = facts.withColumns({
        "deaths_weekly": deaths,
        "half_zeke_time_3": deaths > 0.5,
        "zeke_time_3": deaths > 1,
        "two_zeke_time_3": deaths > 2,
        "icu_2_time_3": ahead("icu_weekly", lead_weeks, w) > 2,
        "perc_covid_10_time_3": ahead("perc_covid_100", lead_weeks, w) > 10,
        "change_admits": change("admits_weekly", w),
        "change_perc": change("perc_covid_100", w),
        "change_cases": change("cases_weekly", w),
        "cdc_flag_1": above,
        "cdc_flag_2": below,
        "cdc_flag": above | below,
        "year": F.year("ymd"),
        "week": epi_week(F.col("ymd")),
        "year_wk": year_week(F.col("ymd")),
    })
    return date_weights(labelled)

"""Shared steps of the three cleaned panels: daily features, weekly sampling and outcome labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.conditions import community_level_parts, per_100k
from riskpanel.functions.dates import epi_week, is_wednesday, weekday_name, year_week
from riskpanel.functions.series import ahead, behind, by_area, change, rolling_mean
from riskpanel.operators.aggregates import date_weights


@dataclass(frozen=True)
class CleaningRules:
    """Dates, rate base and published-level cuts. ``per`` is the population a rate refers to."""

    filter_date: str = "2021-01-01"
    weekly_start: str | None = "2021-03-01"
    per: float = 100000.0
    case_cut: float = 200 / 7
    low: tuple[float, float] = (10 / 7, 0.10)
    high: tuple[float, float] = (20 / 7, 0.15)

    def rate(self, column: str, population: str):
        return per_100k(column, population, self.per)


def with_calendar(df: DataFrame, text_date: str = "date") -> DataFrame:
    d = F.to_date(text_date, "yyyy-MM-dd")
    return df.withColumns({"ymd": d, "year": F.year(d), "week": epi_week(d), "year_wk": year_week(d)})


def daily_features(df: DataFrame, area: str, rules: CleaningRules) -> DataFrame:
    """Published level, future outcomes and past inputs of each area-day.

    Offsets are rows of the daily series, so the weekly sample must come after this step. One sort by area
    serves all of them.
    """
    w = by_area(area)
    above, below = community_level_parts(
        F.col("cases_avg_per_100k"), F.col("admits_confirmed_100K"), F.col("perc_covid"), rules.case_cut, rules.low, rules.high
    )
    out = df.withColumns({
        "cdc_flag_1": above,
        "cdc_flag_2": below,
        "cdc_flag": above | below,
        "deaths_21_lag_100k": ahead("deaths_avg_per_100k", 21, w),
        "icu_21_lag_100K": ahead("icu_100K", 21, w),
        "cases_lag_21_100K": behind("cases_avg_per_100k", 21, w),
        "admits_7_lag": ahead("admits_confirmed_avg", 7, w),
        "admits_7d_ago": behind("admits_confirmed_avg", 7, w),
        "admits_21d_ago": behind("admits_confirmed_avg", 21, w),
        "admits_28d_ago": behind("admits_confirmed_avg", 28, w),
        "dotw": weekday_name(F.col("ymd")),
    })
    return out.where(F.col("ymd") >= F.lit(rules.filter_date).cast("date"))


def weekly_outcomes(df: DataFrame, area: str, rules: CleaningRules, icu_days: int, area_days: DataFrame) -> DataFrame:
    """Wednesday rows with weekly measures, outcome labels, changes and weights.

    ``icu_days`` is 7 where intensive care is a daily average and 1 where it is already on the weekly scale.
    ``area_days`` is the stored area-day table behind ``df``; the population totals per date come from it.
    """
    weekly = df.where(is_wednesday(F.col("ymd")))
    if rules.weekly_start:
        weekly = weekly.where(F.col("ymd") >= F.lit(rules.weekly_start).cast("date"))
    w = by_area(area)
    measures = weekly.withColumns({
        "deaths_21_lag_100k_14d": rolling_mean("deaths_21_lag_100k", 2, w) * 14,
        "deaths_weekly": F.col("deaths_21_lag_100k") * 7,
        "admits_weekly": F.col("admits_confirmed_100K") * 7,
        "icu_weekly": F.col("icu_100K") * icu_days,
        "cases_weekly": F.bround(F.col("cases_avg_per_100k") * 7, 0),
        "cfr": F.try_divide("deaths_avg_per_100k", "cases_lag_21_100K") * 100,
        "perc_covid_100": F.col("perc_covid") * 100,
        "deaths_now_weekly": F.col("deaths_avg_per_100k") * 7,
    })
    deaths = ahead("deaths_now_weekly", 3, w)
    labelled = measures.withColumns({
        "half_zeke_time_3": deaths > 0.5,
        "zeke_time_3": deaths > 1,
        "two_zeke_time_3": deaths > 2,
        "chk2": ahead("deaths_avg_per_100k", 3, w),
        "icu_2_time_3": F.col("icu_21_lag_100K") * icu_days > 2,
        "perc_covid_10_time_3": ahead("perc_covid_100", 3, w) > 10,
        "change_admits": change("admits_weekly", w),
        "change_perc": change("perc_covid_100", w),
        "change_cases": change("cases_weekly", w),
        "zeke_time_3_14d": F.col("deaths_21_lag_100k_14d") > 2,
        "two_zeke_time_3_14d": F.col("deaths_21_lag_100k_14d") > 4,
    })
    return date_weights(labelled, source=area_days)

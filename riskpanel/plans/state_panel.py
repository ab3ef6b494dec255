"""Weekly state panel from daily hospital and case tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions import conditions as C
from riskpanel.functions.series import by_area, rolling_mean
from riskpanel.operators.joins import lookup_inner, lookup_left
from riskpanel.plans.daily import CleaningRules, daily_features, weekly_outcomes, with_calendar

# Names in the case table that are not states.
EXCLUDED = ("American Samoa", "Guam", "Northern Mariana Islands", "Puerto Rico Commonwealth", "U.S. Virgin Islands",
            "United States")


def hospital_features(hospital: DataFrame, rules: CleaningRules) -> DataFrame:
    """Seven-day means of admissions, intensive care and the confirmed share of beds, per state and day."""
    w = by_area("state", "date")

    def total(kind: str, status: str):
        return C.sentinel_to_null(f"total_{kind}_patients_hospitalized_{status}")

    both = "confirmed_and_suspected_covid"
    h = hospital.withColumns({
        "date": F.to_date("date", "yyyy/MM/dd"),
        "admits_confirmed": F.col("previous_day_admission_adult_covid_confirmed")
        + F.col("previous_day_admission_pediatric_covid_confirmed"),
        "den": total("adult", both) + total("pediatric", both),
        "num": total("adult", "confirmed_covid") + total("pediatric", "confirmed_covid"),
    }).withColumns({"num": C.null_unless("num", "den"), "den": C.null_unless("den", "num")})
    share = F.col("percent_of_inpatients_with_covid")
    base = C.ratio_or_one("num", "den")
    h = h.withColumns({"factor_base": base, "factor_count": base > 1, "factor": C.cap_at_one(base)})

    def ratio_of_means(skip_null: bool):
        r = F.try_divide(rolling_mean("num", 7, w, skip_null), rolling_mean("den", 7, w, skip_null))
        return C.cap_at_one(F.coalesce(r, F.lit(1.0)))

    h = h.withColumns({
        "admits_confirmed_avg": rolling_mean("admits_confirmed", 7, w),
        "icu_confirmed_avg": rolling_mean("staffed_icu_adult_patients_confirmed_covid", 7, w),
        "perc_covid_ALL": rolling_mean(share, 7, w),
        "perc_covid": rolling_mean(share * F.col("factor"), 7, w),
        "factor_avg1": ratio_of_means(skip_null=False),
        "factor_avg2": ratio_of_means(skip_null=True),
    }).withColumn("perc_covid_v2", F.col("perc_covid_ALL") * F.col("factor_avg2"))
    return h.where(F.col("date") >= F.lit(rules.filter_date).cast("date"))


def statewide_patch(report: DataFrame, state: str, first: str, last: str) -> DataFrame:
    """Replacement case rates of one state over a range of days; the report stamps date and time in one text."""
    day = F.to_date(F.get(F.split("ReportDate", " "), F.lit(0)), "yyyy/MM/dd")
    dated = report.select(day.alias("ymd"), F.lit(state).alias("state"), "Statewide")
    return dated.where(F.col("ymd").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def clean_state_panel(
    hospital: DataFrame, cases: DataFrame, census: DataFrame, patch: DataFrame, rules: CleaningRules,
    excluded: Sequence[str] = EXCLUDED,
) -> DataFrame:
    """The labelled weekly panel of states."""
    h = hospital_features(hospital, rules)
    known = lookup_inner(cases, census, {"state": "NAME"}, ["POPESTIMATE2019", "ABBR"])
    area_days = with_calendar(known.where(C.not_in("state", excluded)))
    d = lookup_left(area_days, h, {"ABBR": "state", "ymd": "date"}, ["admits_confirmed_avg", "perc_covid", "icu_confirmed_avg"])
    d = d.withColumns({
        "admits_confirmed_100K": rules.rate("admits_confirmed_avg", "POPESTIMATE2019"),
        "icu_100K": rules.rate("icu_confirmed_avg", "POPESTIMATE2019"),
    })
    d = lookup_left(d, patch, {"state": "state", "ymd": "ymd"}, ["Statewide"])
    d = d.withColumns({
        "cases_avg_per_100k": C.patched("Statewide", "cases_avg_per_100k"),
        "perc_covid": C.zero_if_missing("perc_covid"),
    })
    weekly = weekly_outcomes(daily_features(d, "state", rules), "state", rules, 1, area_days)
    return weekly.withColumns({
        "cfr_in_21d": F.try_divide("deaths_weekly", "cases_weekly") * 100,
        "zeke_time_0": F.col("deaths_now_weekly") > 1,
        "two_zeke_time_0": F.col("deaths_now_weekly") > 2,
    })

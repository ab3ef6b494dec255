"""Weekly panels of hospital service areas (groups) and of counties (their members).

Hospital reports come weekly per county with suppressed small counts; they are summed to the group, because patients
cross county lines, and for counties the group's measures are copied back to every member. Cases and deaths come
daily per county.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions import conditions as C
from riskpanel.functions.labels import code_number
from riskpanel.operators import aggregates as A
from riskpanel.operators import joins as J
from riskpanel.operators.ranking import rank_table
from riskpanel.plans.daily import CleaningRules, daily_features, weekly_outcomes, with_calendar
from riskpanel.session import literal_table, materialize

# Names in the county case table that are not states.
EXCLUDED = ("American Samoa", "Guam", "Northern Mariana Islands", "Puerto Rico Commonwealth", "Virgin Islands",
            "United States")
# County codes reported together, the code they are reported under, and which of them stands for all.
REPORTING_UNITS = (
    (36005, 36998, False), (36047, 36998, False), (36061, 36998, False), (36081, 36998, False), (36085, 36998, True),
    (29037, 29998, False), (29047, 29998, False), (29095, 29998, True), (29165, 29998, False),
    (29145, 29997, False), (29097, 29997, True),
    (2164, 2997, False), (2060, 2997, True),
    (2105, 2998, False), (2282, 2998, True),
)
UNIT_NAMES = {36998: "New York City"}
# Counties without a service area, dropped after the weights are set.
WITHOUT_GROUP = (48067, 48203, 48315)

_ADULT = "previous_day_admission_adult_covid_confirmed_7_day_sum"
_CHILD = "previous_day_admission_pediatric_covid_confirmed_7_day_sum"
_BEDS_ADULT = "total_adult_patients_hospitalized_confirmed_covid_7_day_sum"
_BEDS_CHILD = "total_pediatric_patients_hospitalized_confirmed_covid_7_day_sum"
_ICU = "staffed_icu_adult_patients_confirmed_covid_7_day_sum"
_GROUP = ["health_service_area_number", "health_service_area_population"]


def crosswalk(spark, units: Sequence[tuple[int, int, bool]] = REPORTING_UNITS) -> DataFrame:
    return literal_table(spark, units, "code int, unit int, keep boolean")


def group_hospital_weeks(hospital: DataFrame, areas: DataFrame, rules: CleaningRules) -> DataFrame:
    """Weekly hospital measures per group: suppressed counts imputed, summed, put on a daily and per-capita scale."""
    v = C.SUPPRESSED_VALUES
    rows = hospital.withColumn("fips", code_number(F.col("fips_code")))
    rows = J.lookup_left(rows, areas, {"fips": "fips"}, _GROUP)
    rows = rows.withColumns({
        "date": F.date_add(F.to_date("collection_week", "yyyy/MM/dd"), 5),
        "beds_covid": C.impute_suppressed(_BEDS_CHILD, v["beds"]) + C.impute_suppressed(_BEDS_ADULT, v["beds"]),
        "beds": C.impute_suppressed("inpatient_beds_7_day_avg", v["beds"]),
    } | C.impute_columns({_ADULT: v["adult_admissions"], _CHILD: v["paediatric_admissions"], _ICU: v["icu_patients"]}))
    sums = rows.groupBy(*_GROUP, "date").agg(
        F.count(F.lit(1)).alias("n"),
        (A.sum_present(_ADULT) + A.sum_present(_CHILD)).alias("admits_confirmed"),
        A.sum_present("beds_covid").alias("inpt_beds_covid"),
        A.sum_present("beds").alias("inpt_beds"),
        A.sum_present(_ICU).alias("icu_confirmed"),
        A.count_missing(_CHILD).alias("missing_kid"), A.share_missing(_CHILD).alias("missing_kid_perc"),
        A.count_missing(_ADULT).alias("missing_adult"), A.share_missing(_ADULT).alias("missing_adult_perc"),
    )
    sums = sums.withColumns({
        "admits_confirmed_avg": F.col("admits_confirmed") / 7,
        "icu_confirmed_avg": F.col("icu_confirmed") / 7,
        # A group without beds has share 0; an unknown share becomes 0 where it meets the case table.
        "perc_covid": F.try_divide(F.col("inpt_beds_covid") / 7, F.col("inpt_beds")),
    })
    pop = "health_service_area_population"
    return sums.withColumns({
        "admits_confirmed_100K": rules.rate("admits_confirmed_avg", pop),
        "icu_100K": rules.rate("icu_confirmed_avg", pop) / 7,
    })


_HOSPITAL = ["admits_confirmed_avg", "perc_covid", "admits_confirmed_100K", "icu_confirmed_avg", "icu_100K"]


def _filled(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "perc_covid": C.zero_if_missing("perc_covid"),
        "admits_confirmed_100K": C.zero_if_missing("admits_confirmed_100K"),
    })


def _population_ranks(days: DataFrame, rules: CleaningRules) -> DataFrame:
    """Rank of each population over the daily rows of the study, largest first. The rows are counted by population
    before any hospital join, so ranking adds no pass over the joined table."""
    kept = days.where(F.col("ymd") >= F.lit(rules.filter_date).cast("date"))
    return rank_table(kept, "POPESTIMATE2019", "county_rank")


def clean_group_panel(
    hospital: DataFrame, cases: DataFrame, areas: DataFrame, rules: CleaningRules,
    units: Sequence[tuple[int, int, bool]] = REPORTING_UNITS, excluded: Sequence[str] = EXCLUDED,
) -> DataFrame:
    """The labelled weekly panel of groups. ``areas`` is one snapshot of the county-to-group lookup."""
    spark = hospital.sparkSession
    h = group_hospital_weeks(hospital, areas, rules).where(F.col("date") >= F.lit(rules.filter_date).cast("date"))
    # A combined unit lies in one group, so any of its counties stands for it.
    one_member = crosswalk(spark, [(unit, code, True) for code, unit, keep in units if keep])
    c = cases.where(C.not_in("state", excluded) & (F.col("county") != "Unknown"))
    c = J.remap_codes(c.withColumn("fips", code_number(F.col("geoid"), "USA-")), "fips", one_member)
    c = J.lookup_left(c, areas, {"fips": "fips"}, ["health_service_area", *_GROUP])
    d = c.groupBy("date", "health_service_area", *_GROUP).agg(
        A.sum_present("cases_avg").alias("cases_avg"), A.sum_present("deaths_avg").alias("deaths_avg"))
    pop = "health_service_area_population"
    d = with_calendar(d).withColumns({
        "cases_avg_per_100k": rules.rate("cases_avg", pop),
        "deaths_avg_per_100k": rules.rate("deaths_avg", pop),
        "POPESTIMATE2019": F.col(pop),
    })
    # The raw case table is read once: ranks, weights and the panel all start from the area-day table.
    area_days = materialize(d, "group_days")
    ranks = _population_ranks(area_days, rules)
    # Counties without a group number form their own group on both sides.
    d = J.lookup_null_safe(area_days, h, {"health_service_area_number": "health_service_area_number", "ymd": "date"}, _HOSPITAL)
    d = daily_features(_filled(d), "health_service_area_number", rules)
    weekly = weekly_outcomes(d, "health_service_area_number", rules, 7, area_days)
    weekly = weekly.withColumn("state", F.col("health_service_area_number"))
    return J.lookup_left(weekly, ranks, {"POPESTIMATE2019": "POPESTIMATE2019"}, ["county_rank"])


def member_populations(census: DataFrame, cw: DataFrame, names: dict[int, str] = UNIT_NAMES) -> DataFrame:
    """County populations with reporting units merged and named."""
    coded = census.withColumn("fips", code_number(F.col("FIPS")))
    merged = J.remap_codes(coded.withColumn("own", F.col("fips")), "fips", cw).groupBy("fips", "STNAME").agg(
        F.sum("POPESTIMATE2019").alias("POPESTIMATE2019"), A.first_by("CTYNAME", ["own"]).alias("CTYNAME"))
    label = F.col("CTYNAME")
    for code, name in names.items():
        label = F.when(F.col("fips") == code, name).otherwise(label)
    return merged.withColumn("CTYNAME", label)


def clean_member_panel(
    hospital: DataFrame, cases: DataFrame, areas: DataFrame, census: DataFrame, rules: CleaningRules,
    units: Sequence[tuple[int, int, bool]] = REPORTING_UNITS, excluded: Sequence[str] = EXCLUDED,
    without_group: Sequence[int] = WITHOUT_GROUP,
) -> DataFrame:
    """The labelled weekly panel of counties, with the hospital measures of their group."""
    spark = hospital.sparkSession
    cw = crosswalk(spark, units)
    h = group_hospital_weeks(hospital, areas, rules).where(F.col("date") > F.lit(rules.filter_date).cast("date"))
    members = J.representatives(areas.select("health_service_area_number", "fips"), "fips", cw)
    h = J.lookup_null_safe(h, members, {"health_service_area_number": "health_service_area_number"}, ["fips"])

    c = J.remap_codes(cases.where(C.not_in("state", excluded)).withColumn("fips", code_number(F.col("geoid"), "USA-")), "fips", cw)
    d = c.groupBy("fips", "date").agg(
        A.first_by("county", ["geoid"]).alias("county"), A.first_by("state", ["geoid"]).alias("state_name"),
        A.sum_present("cases_avg").alias("cases_avg"), A.sum_present("deaths_avg").alias("deaths_avg"))
    d = J.lookup_inner(d, member_populations(census, cw), {"fips": "fips"}, ["POPESTIMATE2019", "CTYNAME"])
    d = with_calendar(d).withColumns({
        "cases_avg_per_100k": rules.rate("cases_avg", "POPESTIMATE2019"),
        "deaths_avg_per_100k": rules.rate("deaths_avg", "POPESTIMATE2019"),
    })
    area_days = materialize(d, "member_days")
    ranks = _population_ranks(area_days, rules)
    d = J.lookup_left(area_days, h, {"fips": "fips", "ymd": "date"}, ["health_service_area_population", *_HOSPITAL])
    d = daily_features(_filled(d), "fips", rules)
    weekly = weekly_outcomes(d, "fips", rules, 7, area_days).withColumn("state", F.col("fips"))
    weekly = J.lookup_left(weekly, ranks, {"POPESTIMATE2019": "POPESTIMATE2019"}, ["county_rank"])
    return weekly.where(C.not_in("fips", without_group))

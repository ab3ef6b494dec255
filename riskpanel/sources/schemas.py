"""Declared schemas of the raw inputs; no reader infers types. Column names of the published files."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(strings: str = "", doubles: str = "", ints: str = "", longs: str = "") -> T.StructType:
    kinds = ((strings, T.StringType()), (ints, T.IntegerType()), (longs, T.LongType()), (doubles, T.DoubleType()))
    return T.StructType([T.StructField(n, t) for names, t in kinds for n in names.split()])


HOSPITAL_WEEKLY = _schema(
    strings="fips_code collection_week",
    doubles="previous_day_admission_adult_covid_confirmed_7_day_sum "
    "previous_day_admission_pediatric_covid_confirmed_7_day_sum "
    "total_adult_patients_hospitalized_confirmed_covid_7_day_sum "
    "total_pediatric_patients_hospitalized_confirmed_covid_7_day_sum "
    "inpatient_beds_7_day_avg staffed_icu_adult_patients_confirmed_covid_7_day_sum",
)
HOSPITAL_DAILY = _schema(
    strings="state date",
    doubles="previous_day_admission_adult_covid_confirmed previous_day_admission_pediatric_covid_confirmed "
    "staffed_icu_adult_patients_confirmed_covid percent_of_inpatients_with_covid "
    "total_adult_patients_hospitalized_confirmed_and_suspected_covid "
    "total_pediatric_patients_hospitalized_confirmed_and_suspected_covid "
    "total_adult_patients_hospitalized_confirmed_covid total_pediatric_patients_hospitalized_confirmed_covid",
)
COUNTY_CASES = _schema(
    strings="date geoid county state",
    doubles="cases_avg cases_avg_per_100k deaths_avg deaths_avg_per_100k",
)
STATE_CASES = _schema(strings="date state", doubles="cases_avg_per_100k deaths_avg_per_100k")
SERVICE_AREAS = _schema(
    strings="date_updated county county_fips state health_service_area",
    ints="health_service_area_number", longs="county_population health_service_area_population",
)
STATE_CENSUS = _schema(strings="NAME ABBR", longs="POPESTIMATE2019")
COUNTY_CENSUS = _schema(strings="FIPS STNAME CTYNAME", longs="POPESTIMATE2019")
STATEWIDE_PATCH = T.StructType([
    T.StructField("OBJECTID", T.IntegerType()),
    T.StructField("ReportDate", T.StringType()),
    T.StructField("Statewide", T.DoubleType()),
])
CROSSWALK = T.StructType([
    T.StructField("FIPS_Name", T.StringType()),
    T.StructField("FIPS_Code", T.IntegerType()),
    T.StructField("NYT_Code", T.IntegerType()),
    T.StructField("NYT_Name", T.StringType()),
    T.StructField("Notes", T.StringType()),
])

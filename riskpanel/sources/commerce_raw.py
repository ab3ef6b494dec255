"""Order tables in the layout of the raw surveillance files, so that the cleaning plans run on them unchanged.

A nation is a state, a nation's market segment a service area, a quarter of a segment a county. Counts of one are
suppressed, absent measures are NULL, four counties of one area report together under one code, and one county
reports as unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.sources.commerce import SCALE, table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
# Counties reported under one code, and counties merged on arrival: (county, unit, stands for the unit).
UNITS = [(1010, 9001, True), (1011, 9001, False), (1012, 9001, False), (1013, 9001, False),
         (2010, 9002, True), (2011, 9002, False), (2012, 9002, False), (2013, 9002, False)]
REPORTED_TOGETHER = 9001
UNKNOWN_COUNTY = 3053
SUPPRESSED = -999999.0


def _suppressed(c, small=1):
    return F.when(c == small, SUPPRESSED).otherwise(c.cast("double"))


def counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their county, service area and state codes."""
    seg = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")).cast("int")
    nation = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", nation,
        (nation * 10 + seg).alias("hsa"),
        (nation * 1000 + seg * 10 + F.col("c_custkey") % 4).cast("int").alias("fips"),
    )


def _code_text(c) -> F.Column:
    return F.lpad(c.cast("string"), 5, "0")


def service_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County-to-area lookup in two publications; the older one holds other numbers."""
    c = counties(spark, sf_dir)
    pops = c.groupBy("fips", "hsa", "c_nationkey").agg(F.count(F.lit(1)).alias("county_population"))
    areas = c.groupBy(F.col("hsa").alias("k")).agg(F.count(F.lit(1)).alias("health_service_area_population"))
    rows = pops.join(areas, F.col("hsa") == F.col("k")).select(
        F.concat(F.lit("County "), "fips").alias("county"), _code_text(F.col("fips")).alias("county_fips"),
        F.concat(F.lit("NATION_"), "c_nationkey").alias("state"), "county_population",
        F.col("hsa").alias("health_service_area_number"), F.concat(F.lit("Area "), "hsa").alias("health_service_area"),
        "health_service_area_population",
    )
    old = rows.withColumns({"health_service_area_number": F.lit(0), "date_updated": F.lit("2022-04-28")})
    return rows.withColumn("date_updated", F.lit("2022-05-05")).unionByName(old)


def county_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counties(spark, sf_dir).groupBy("fips", "c_nationkey").agg(F.count(F.lit(1)).alias("POPESTIMATE2019"))
    return c.select(_code_text(F.col("fips")).alias("FIPS"), F.concat(F.lit("NATION_"), "c_nationkey").alias("STNAME"),
                    F.concat(F.lit("County "), "fips").alias("CTYNAME"), "POPESTIMATE2019")


def _lines(spark: SparkSession, sf_dir: str, key: str, day) -> DataFrame:
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(
        counties(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", key)
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", day(F.col("l_shipdate").cast("date")).alias("day"), "l_returnflag", "l_quantity", "l_discount")
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    return lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(key, "day").agg(
        F.count_if(flag == "R").alias("n_r"), F.count_if(flag == "A").alias("n_a"), F.count_if(flag == "N").alias("n_n"),
        F.sum(F.when(flag == "N", q)).alias("q_n"), F.sum(F.when(flag != "N", q)).alias("q_ra"),
        F.sum(q).alias("q"), F.count_if(q >= 25).alias("n_big"), F.count(F.lit(1)).alias("n_lines"),
        F.avg("l_discount").alias("disc"),
    )


def hospital_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly reports per county; the collection week starts on a Friday."""
    friday = lambda d: F.date_sub(d, (F.dayofweek(d) + 1) % 7)
    x = _lines(spark, sf_dir, "fips", friday)
    return x.select(
        _code_text(F.col("fips")).alias("fips_code"), F.date_format("day", "yyyy/MM/dd").alias("collection_week"),
        _suppressed(F.col("n_r")).alias("previous_day_admission_adult_covid_confirmed_7_day_sum"),
        F.when(F.col("n_a") > 0, _suppressed(F.col("n_a"))).alias("previous_day_admission_pediatric_covid_confirmed_7_day_sum"),
        F.when(F.col("q_n") < 10, SUPPRESSED).otherwise(F.col("q_n")).alias(
            "total_adult_patients_hospitalized_confirmed_covid_7_day_sum"),
        F.col("n_n").cast("double").alias("total_pediatric_patients_hospitalized_confirmed_covid_7_day_sum"),
        F.when(F.col("n_lines") == 1, 0.0).otherwise(F.col("q")).alias("inpatient_beds_7_day_avg"),
        _suppressed(F.col("n_big")).alias("staffed_icu_adult_patients_confirmed_covid_7_day_sum"),
    )


def _days(spark: SparkSession, sf_dir: str, areas: DataFrame) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    first, last = d.select(F.min("d")).scalar(), d.select(F.max("d")).scalar()
    return areas.withColumn("day", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 DAY"))))


def _order_days(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus", "o_orderpriority")
    return o.join(counties(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).groupBy(key, "day").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"))


def county_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cases of every county and day."""
    areas = counties(spark, sf_dir).select("fips", "c_nationkey").distinct()
    x = _days(spark, sf_dir, areas).join(_order_days(spark, sf_dir, "fips"), ["fips", "day"], "left")
    unknown = F.col("fips") == UNKNOWN_COUNTY
    together = [code for code, unit, _ in UNITS if unit == REPORTED_TOGETHER]
    code = F.when(F.col("fips").isin(together), REPORTED_TOGETHER).when(unknown, 99999).otherwise(F.col("fips"))
    daily = x.withColumn("code", code).groupBy("code", "c_nationkey", "day").agg(
        F.sum(F.coalesce("n", F.lit(0))).cast("double").alias("cases_avg"),
        F.sum(F.coalesce("n_f", F.lit(0))).cast("double").alias("deaths_avg"))
    return daily.select(
        F.date_format("day", "yyyy-MM-dd").alias("date"), F.concat(F.lit("USA-"), _code_text(F.col("code"))).alias("geoid"),
        F.when(F.col("code") == 99999, "Unknown").otherwise(F.concat(F.lit("County "), "code")).alias("county"),
        F.concat(F.lit("NATION_"), "c_nationkey").alias("state"), "cases_avg", "deaths_avg",
    )


def state_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations by state; one nation is not a state."""
    c = counties(spark, sf_dir).where("c_nationkey <> 24").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("POPESTIMATE2019"))
    return c.select(F.concat(F.lit("NATION_"), "c_nationkey").alias("NAME"),
                    F.concat(F.lit("S"), "c_nationkey").alias("ABBR"), "POPESTIMATE2019")


def state_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pops = counties(spark, sf_dir).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("pop"))
    x = _days(spark, sf_dir, pops).join(_order_days(spark, sf_dir, "c_nationkey"), ["c_nationkey", "day"], "left")
    return x.select(
        F.date_format("day", "yyyy-MM-dd").alias("date"), F.concat(F.lit("NATION_"), "c_nationkey").alias("state"),
        (F.coalesce("n", F.lit(0)) * SCALE / F.col("pop")).alias("cases_avg_per_100k"),
        (F.coalesce("n_f", F.lit(0)) * SCALE / F.col("pop")).alias("deaths_avg_per_100k"))


def hospital_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily reports per state; a day without lines has no measures."""
    areas = counties(spark, sf_dir).select("c_nationkey").distinct()
    x = _days(spark, sf_dir, areas).join(_lines(spark, sf_dir, "c_nationkey", lambda d: d), ["c_nationkey", "day"], "left")
    return x.select(
        F.concat(F.lit("S"), "c_nationkey").alias("state"), F.date_format("day", "yyyy/MM/dd").alias("date"),
        F.col("n_r").cast("double").alias("previous_day_admission_adult_covid_confirmed"),
        F.col("n_a").cast("double").alias("previous_day_admission_pediatric_covid_confirmed"),
        F.col("n_big").cast("double").alias("staffed_icu_adult_patients_confirmed_covid"),
        F.col("disc").alias("percent_of_inpatients_with_covid"),
        F.when(F.col("n_lines") == 1, SUPPRESSED).otherwise(F.col("q")).alias(
            "total_adult_patients_hospitalized_confirmed_and_suspected_covid"),
        F.col("n_lines").cast("double").alias("total_pediatric_patients_hospitalized_confirmed_and_suspected_covid"),
        F.when(F.col("n_a") == 2, SUPPRESSED).otherwise(F.col("q_ra")).alias(
            "total_adult_patients_hospitalized_confirmed_covid"),
        F.col("n_r").cast("double").alias("total_pediatric_patients_hospitalized_confirmed_covid"),
    )


def statewide_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state's own daily rate, stamped with date and time in one text."""
    pop = counties(spark, sf_dir).where("c_nationkey = 7").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("pop"))
    x = _days(spark, sf_dir, pop).join(_order_days(spark, sf_dir, "c_nationkey"), ["c_nationkey", "day"], "left")
    return x.select(
        F.concat(F.date_format("day", "yyyy/MM/dd"), F.lit(" 14:00:00+00")).alias("ReportDate"),
        (F.coalesce("n_urgent", F.lit(0)) * SCALE / F.col("pop")).alias("Statewide"))

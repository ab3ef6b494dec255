"""Surveillance roles for order tables.

The test tables hold no health measures, so customers stand for residents, orders for cases, closed orders for
deaths, returned lines for admissions and shipped quantity for intensive care. Areas nest: nation (state),
nation x market segment (group), and quarter of a segment (member).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.functions.dates import week_start
from riskpanel.session import materialize

LEVELS = ("state", "group", "member")
# Events per 100 residents take the place of events per 100,000.
SCALE = 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def area_key(level: str) -> Column:
    nation, segment = F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    return {
        "state": nation,
        "group": F.concat_ws("-", nation, segment),
        "member": F.concat_ws("-", nation, segment, F.col("c_custkey") % 4),
    }[level]


def residents(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", area_key(level).alias("area"))


def populations(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    return residents(spark, sf_dir, level).groupBy("area").agg(F.count(F.lit(1)).alias("population"))


def order_facts(spark: SparkSession, sf_dir: str, level: str, period) -> DataFrame:
    """Orders by area and period. Counting directly above the join keeps one shuffle of the raw orders; a customer
    with a large share of them is split by adaptive skew handling and shrinks in the partial aggregate."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", period(F.col("o_orderdate").cast("date")).alias("ymd"),
        (F.col("o_orderstatus") == "F").alias("closed"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    joined = orders.join(residents(spark, sf_dir, level), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("area", "ymd").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("closed").alias("deaths"),
        F.count_if("urgent").alias("urgent"),
    )


def line_facts(spark: SparkSession, sf_dir: str, level: str, period) -> DataFrame:
    """Order lines by area and shipping period. Orders meet their (smaller) customers first, so the lines are
    shuffled once, by order, and are aggregated in the same stage as the join."""
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(
        residents(spark, sf_dir, level), F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", "area")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", period(F.col("l_shipdate").cast("date")).alias("ymd"), "l_returnflag", "l_quantity"
    )
    joined = lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("area", "ymd").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("admits"), F.sum("l_quantity").alias("icu")
    )


_stored: dict[tuple, DataFrame] = {}


def _member_days(spark: SparkSession, sf_dir: str, name: str, facts, inputs: tuple[str, ...]) -> DataFrame:
    """The facts of the finest areas by day, kept in the shared folder and used again as long as the input tables consist of the same files."""
    files = tuple(f for t in inputs for f in sorted(table(spark, sf_dir, t).inputFiles()))
    key = (spark.sparkContext.applicationId, name, files)
    if key not in _stored:
        _stored[key] = materialize(facts(spark, sf_dir, "member", lambda d: d), name)
    return _stored[key]


def _containing(area: Column, level: str) -> Column:
    """The area of a level that contains a member area."""
    return {"state": F.substring_index(area, "-", 1), "group": F.regexp_replace(area, "-[^-]*$", ""), "member": area}[level]


def rolled_orders(spark: SparkSession, sf_dir: str, level: str, period) -> DataFrame:
    """``order_facts`` from the stored member areas: orders are joined once per session, whatever levels and periods are asked for."""
    days = _member_days(spark, sf_dir, "member_orders", order_facts, ("customer", "orders"))
    return days.groupBy(_containing(F.col("area"), level).alias("area"), period(F.col("ymd")).alias("ymd")).agg(
        F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths"), F.sum("urgent").alias("urgent"))


def rolled_lines(spark: SparkSession, sf_dir: str, level: str, period) -> DataFrame:
    """``line_facts`` likewise."""
    days = _member_days(spark, sf_dir, "member_lines", line_facts, ("customer", "orders", "lineitem"))
    return days.groupBy(_containing(F.col("area"), level).alias("area"), period(F.col("ymd")).alias("ymd")).agg(
        F.sum("admits").alias("admits"), F.sum("icu").alias("icu"))


def week_grid(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """Every area in every week from the first to the last order."""
    weeks = table(spark, sf_dir, "orders").select(week_start(F.col("o_orderdate").cast("date")).alias("w"))
    first, last = weeks.select(F.min("w")).scalar(), weeks.select(F.max("w")).scalar()
    return populations(spark, sf_dir, level).select(
        "area", "population",
        F.explode(F.sequence(first, last, F.expr("INTERVAL 7 DAYS"))).alias("ymd"),
    )


def weekly_facts(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """Dense area x week table of rates. A week without any shipped line has unknown admissions."""
    keys = ["area", "ymd"]
    joined = (
        week_grid(spark, sf_dir, level)
        .join(rolled_orders(spark, sf_dir, level, week_start), keys, "left")
        .join(rolled_lines(spark, sf_dir, level, week_start), keys, "left")
    )
    pop = F.col("population").cast("double")
    zero = F.lit(0)
    return joined.select(
        F.col("area").alias("state"), "ymd", F.col("population").alias("POPESTIMATE2019"),
        (F.coalesce("cases", zero) * SCALE / pop).alias("cases_weekly"),
        (F.coalesce("deaths", zero) * SCALE / pop).alias("deaths_now_weekly"),
        (F.coalesce(F.col("urgent") / F.col("cases"), F.lit(0.0)) * 100).alias("perc_covid_100"),
        (F.col("admits") * SCALE / pop).alias("admits_weekly"),
        (F.col("icu") / pop).alias("icu_weekly"),
    )

"""Sources, sinks and generators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskpanel.functions.labels import recode
from riskpanel.operators import joins as J
from riskpanel.operators import logistic as L
from riskpanel.operators.reshape import stack
from riskpanel.queries import query
from riskpanel.queries import shared as X
from riskpanel.session import scratch_path
from riskpanel.sources import tables as IO
from riskpanel.sources.commerce import LEVELS, rolled_orders, table

_DAILY = T.StructType([
    T.StructField("date", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("cases", T.LongType()), T.StructField("deaths", T.LongType()),
])
_DAILY_SQL = """daily AS (SELECT CAST(o_orderdate AS DATE) AS ymd, CAST(c_nationkey AS VARCHAR) AS state,
  count(*) AS cases, count(*) FILTER (WHERE o_orderstatus = 'F') AS deaths
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _daily(spark, sf_dir):
    facts = rolled_orders(spark, sf_dir, "state", lambda d: d)
    return facts.select(F.date_format("ymd", "yyyy-MM-dd").alias("date"), F.col("area").alias("state"), "cases", "deaths")


@query("src_csv_roundtrip", f"WITH {_DAILY_SQL} SELECT ymd, state, cases, deaths FROM daily")
def src_csv_roundtrip(spark, sf_dir):
    """Daily case table out to header CSV and back through its declared schema."""
    path = scratch_path(spark, "daily_csv")
    IO.write_csv(_daily(spark, sf_dir), path)
    back = IO.read_csv(spark, path, _DAILY)
    return back.select(F.to_date("date", "yyyy-MM-dd").alias("ymd"), "state", "cases", "deaths")


@query("union_years", f"""WITH {_DAILY_SQL} SELECT CAST(year(ymd) AS INTEGER) AS year, state, count(*) AS days,
  CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(deaths) AS BIGINT) AS deaths FROM daily GROUP BY ALL""")
def union_years(spark, sf_dir):
    """One CSV folder per year, stacked into one table by a single scan; partition discovery finds the years there are."""
    root = scratch_path(spark, "daily_by_year")
    daily = _daily(spark, sf_dir).withColumn("y", F.substring("date", 1, 4))
    daily.write.partitionBy("y").option("header", True).csv(root)
    stacked = IO.read_csv(spark, root, _DAILY).withColumn("year", F.year(F.to_date("date", "yyyy-MM-dd")))
    return stacked.groupBy("year", "state").agg(
        F.count(F.lit(1)).alias("days"), F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths")
    )


@query("lookup_snapshot", """WITH dated AS (
  SELECT n_nationkey, n_name || ' v1' AS n_name, DATE '2022-04-28' AS published FROM nation
  UNION ALL SELECT n_nationkey, n_name || ' v2', DATE '2022-05-05' FROM nation WHERE n_regionkey <> 4)
SELECT c_nationkey, n_name, count(*) AS customers, round(sum(c_acctbal), 4) AS acctbal FROM customer
LEFT JOIN (SELECT * FROM dated WHERE published + 1 = DATE '2022-05-06') ON c_nationkey = n_nationkey GROUP BY ALL""")
def lookup_snapshot(spark, sf_dir):
    """One publication of a dated lookup, chosen before the join."""
    nation = table(spark, sf_dir, "nation")
    dated = stack([
        nation.withColumns({"n_name": F.concat("n_name", F.lit(" v1")), "published": F.lit(date(2022, 4, 28))}),
        nation.where("n_regionkey <> 4").withColumns(
            {"n_name": F.concat("n_name", F.lit(" v2")), "published": F.lit(date(2022, 5, 5))}),
    ])
    one = J.snapshot(dated, F.col("published"), date(2022, 5, 6))
    joined = J.lookup_left(table(spark, sf_dir, "customer"), one, {"c_nationkey": "n_nationkey"}, ["n_name"])
    return joined.groupBy("c_nationkey", "n_name").agg(
        F.count(F.lit(1)).alias("customers"), X.rnd(F.sum("c_acctbal"), 4).alias("acctbal")
    )


@query("panel_roundtrip", f"""WITH {X.panel_sql('group')} SELECT state, count(*) AS weeks,
  round(sum(cases_weekly), 4) AS cases, round(sum(admits_weekly), 4) AS admits,
  count(*) FILTER (WHERE zeke_time_3) AS severe FROM panel GROUP BY state""")
def panel_roundtrip(spark, sf_dir):
    """All geographies appended to one partitioned panel dataset; one is read back by partition."""
    path = scratch_path(spark, "panels")
    for level in LEVELS:
        IO.write_panel(X.panel(spark, sf_dir, level), path, level)
    back = IO.read_panel(spark, path, "group")
    return back.groupBy("state").agg(
        F.count(F.lit(1)).alias("weeks"), X.rnd(F.sum("cases_weekly"), 4).alias("cases"),
        X.rnd(F.sum("admits_weekly"), 4).alias("admits"), F.count_if("zeke_time_3").alias("severe"),
    )


_SPEC_ROWS = ", ".join(
    f"({i}, '{s.name}', {str(s.quarterly).lower()}, {len(s.features)}, "
    + ", ".join(str(f in s.features).lower() for f in L.FEATURES) + ")"
    for i, s in enumerate(L.SPECS, 1)
)
_SPEC_OK = " AND ".join(f"(NOT m_{k} OR {v} IS NOT NULL)" for k, v in zip(
    L.FEATURES, ("cases_weekly", "admits_weekly", "perc_covid_100", "0", "change_admits", "change_perc", "change_cases"),
    strict=True))


@query("spec_grid", f"""WITH {X.panel_sql('member')}, specs(spec_id, spec, quarterly, n_features,
  {', '.join('m_' + f for f in L.FEATURES)}) AS (VALUES {_SPEC_ROWS})
SELECT CAST(spec_id AS INTEGER) AS spec_id, spec, quarterly, CAST(n_features AS INTEGER) AS n_features,
  count(*) FILTER (WHERE {_SPEC_OK} AND zeke_time_3 IS NOT NULL) AS n_complete
FROM specs CROSS JOIN panel GROUP BY ALL""")
def spec_grid(spark, sf_dir):
    """The model specifications with the panel rows each can train on.

    Rows are first counted by pattern of known features; only the patterns meet the specifications.
    """
    p = X.panel(spark, sf_dir, "member").where("zeke_time_3 IS NOT NULL").withColumn("current_zeke", F.lit(0.0))
    return L.complete_rows(p)


@query("date_series", """WITH days AS (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate),
  INTERVAL 1 DAY)) AS DATE) AS ymd FROM orders)
SELECT d.ymd, count(o_orderkey) AS cases FROM days d LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d.ymd GROUP BY 1""")
def date_series(spark, sf_dir):
    """Every day of the study with its orders; days without any are kept."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("ymd"))
    counts = orders.groupBy("ymd").agg(F.count(F.lit(1)).alias("cases"))
    days = orders.agg(F.min("ymd").alias("a"), F.max("ymd").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("ymd")
    )
    return days.join(counts, "ymd", "left").select("ymd", F.coalesce("cases", F.lit(0)).alias("cases"))


@query("union_fill", """SELECT type, key, label, day, round(amount, 4) AS amount FROM (
  SELECT 'customer' AS type, c_custkey AS key, c_mktsegment AS label, CAST(NULL AS DATE) AS day, c_acctbal AS amount
  FROM customer UNION ALL SELECT 'supplier', s_suppkey, NULL, NULL, s_acctbal FROM supplier
  UNION ALL SELECT 'order', o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE), o_totalprice FROM orders)""")
def union_fill(spark, sf_dir):
    """Tagged union of frames with different columns; what a frame lacks is NULL."""
    from riskpanel.operators.reshape import stack_tagged

    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("amount"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("amount"))
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("label"),
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("amount"))
    out = stack_tagged({"customer": c, "supplier": s, "order": o})
    return X.rounded(out.select("type", "key", "label", "day", "amount"), 4)

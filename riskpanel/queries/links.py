"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel.operators import joins as J
from riskpanel.queries import query
from riskpanel.queries import shared as X
from riskpanel.sources import commerce as K
from riskpanel.sources.commerce import table

def _n():
    return F.count(F.lit(1)).alias("n")

_DAY = "CAST(o_orderdate AS DATE)"


@query("join_lookup_left", """SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 4) AS acctbal FROM customer
  LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON c_nationkey = n_nationkey GROUP BY ALL""")
def join_lookup_left(spark, sf_dir):
    lookup = table(spark, sf_dir, "nation").where("n_regionkey <> 3")
    joined = J.lookup_left(table(spark, sf_dir, "customer"), lookup, {"c_nationkey": "n_nationkey"}, ["n_name"])
    return joined.groupBy("n_name", "c_mktsegment").agg(_n(), X.rnd(F.sum("c_acctbal"), 4).alias("acctbal"))


@query("join_inner_via_left", f"""SELECT n_name, {_DAY} AS ymd, count(*) AS cases FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON c_nationkey = n_nationkey
  GROUP BY ALL""")
def join_inner_via_left(spark, sf_dir):
    """Areas unknown to the lookup are dropped in the join itself. Orders are counted by nation before they meet it."""
    facts = K.rolled_orders(spark, sf_dir, "state", lambda d: d)
    lookup = table(spark, sf_dir, "nation").where("n_regionkey <> 3").withColumn("code", F.col("n_nationkey").cast("string"))
    return J.lookup_inner(facts, lookup, {"area": "code"}, ["n_name"]).select("n_name", "ymd", "cases")


_DAILY_SQL = f"""o AS (SELECT CAST(c_nationkey AS VARCHAR) AS state, {_DAY} AS ymd, count(*) AS cases FROM orders
  JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
h AS (SELECT CAST(c_nationkey AS VARCHAR) AS area, CAST(l_shipdate AS DATE) AS day,
  count(*) FILTER (WHERE l_returnflag = 'R') AS admits, sum(l_quantity) AS icu FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


@query("join_area_date", f"""WITH {_DAILY_SQL} SELECT state, ymd, cases, admits, round(icu, 4) AS icu
  FROM o LEFT JOIN h ON state = area AND ymd = day""")
def join_area_date(spark, sf_dir):
    """Daily cases with the same area's hospital day; the two keys have different names on each side."""
    o = K.rolled_orders(spark, sf_dir, "state", lambda d: d).select(F.col("area").alias("state"), "ymd", "cases")
    h = K.rolled_lines(spark, sf_dir, "state", lambda d: d).withColumnRenamed("ymd", "day")
    joined = J.lookup_left(o, h, {"state": "area", "ymd": "day"}, ["admits", "icu"])
    return X.rounded(joined, 4)


@query("join_fanout_members", f"""WITH {X.panel_sql('group')},
members AS (SELECT DISTINCT c_nationkey || '-' || c_mktsegment AS grp, {X.AREA_SQL['member']} AS member FROM customer)
SELECT member, ymd, round(admits_weekly, 6) AS admits_weekly, round(icu_weekly, 6) AS icu_weekly
FROM panel LEFT JOIN members ON state = grp""")
def join_fanout_members(spark, sf_dir):
    """Group measures copied to every member of the group."""
    c = table(spark, sf_dir, "customer")
    members = c.select(K.area_key("group").alias("grp"), K.area_key("member").alias("member")).distinct()
    p = X.panel(spark, sf_dir, "group").select("state", "ymd", "admits_weekly", "icu_weekly")
    return X.rounded(J.lookup_left(p, members, {"state": "grp"}, ["member"]).drop("state"))


_SEG = "nullif(c_mktsegment, 'BUILDING')"


@query("join_null_safe", f"""WITH o AS (SELECT {_SEG} AS seg, CAST(date_trunc('week', o_orderdate) AS DATE) AS ymd,
  count(*) AS cases FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
h AS (SELECT {_SEG} AS seg2, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS icu FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT seg, ymd, cases, round(icu, 4) AS icu FROM o LEFT JOIN h ON seg IS NOT DISTINCT FROM seg2 AND ymd = week""")
def join_null_safe(spark, sf_dir):
    """Rows without a group number meet the other table's rows without one."""
    from riskpanel.functions.dates import week_start

    seg = F.nullif(F.split_part("area", F.lit("-"), F.lit(2)), F.lit("BUILDING"))
    o = K.rolled_orders(spark, sf_dir, "group", week_start).groupBy(seg.alias("seg"), "ymd").agg(F.sum("cases").alias("cases"))
    h = K.rolled_lines(spark, sf_dir, "group", week_start).groupBy(seg.alias("seg2"), F.col("ymd").alias("week")).agg(
        F.sum("icu").alias("icu"))
    return X.rounded(J.lookup_null_safe(o, h, {"seg": "seg2", "ymd": "week"}, ["icu"]), 4)


@query("semi_join_dates", f"""SELECT {_DAY} AS ymd, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders
  WHERE {_DAY} IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R')
  GROUP BY 1""")
def semi_join_dates(spark, sf_dir):
    """Days that occur in another table's dates; those dates are made distinct first, so no day is hot."""
    days = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_returnflag = 'R'").select(
        F.col("l_shipdate").cast("date").alias("ymd")).distinct()
    by_day = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ymd")).agg(
        _n(), X.rnd(F.sum("o_totalprice"), 2).alias("amount"))
    return by_day.join(days, "ymd", "left_semi")


@query("anti_join_unmatched", """SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL) GROUP BY ALL""")
def anti_join_unmatched(spark, sf_dir):
    """Coverage check: residents without any closed order."""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    left = table(spark, sf_dir, "customer").join(seen, "c_custkey", "left_anti")
    return left.groupBy("c_nationkey", "c_mktsegment").agg(_n())


@query("reconcile_rollups", f"""WITH {X.facts_sql('group')}, g AS (SELECT split_part(state, '-', 1) AS area, ymd,
  sum(cases_weekly * POPESTIMATE2019 / 100) AS cases, sum(coalesce(admits_weekly, 0) * POPESTIMATE2019 / 100) AS admits
  FROM facts GROUP BY 1, 2),
s AS (SELECT c_nationkey || '' AS area, CAST(date_trunc('week', o_orderdate) AS DATE) AS ymd, count(*) AS cases
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
j AS (SELECT g.area, g.ymd, coalesce(s.cases, 0) AS a, g.cases AS b FROM g LEFT JOIN s ON g.area = s.area AND g.ymd = s.ymd)
SELECT 'area' AS axis, area AS key, round(sum(b) / nullif(sum(a), 0), 6) AS ratio FROM j GROUP BY 2
UNION ALL SELECT 'date', CAST(ymd AS VARCHAR), round(sum(b) / nullif(sum(a), 0), 6) FROM j GROUP BY 2""")
def reconcile_rollups(spark, sf_dir):
    """Totals of the state and group sources compared by area and by date."""
    from riskpanel.operators.quality import reconcile

    pop = F.col("POPESTIMATE2019") / 100
    groups = X.panel(spark, sf_dir, "group").select(
        F.split_part("state", F.lit("-"), F.lit(1)).alias("area"), "ymd", (F.col("cases_weekly") * pop).alias("value"))
    states = X.panel(spark, sf_dir).select(
        F.col("state").alias("area"), "ymd", (F.col("cases_weekly") * pop).alias("value"))
    return X.rounded(reconcile(groups, states, {"area": "area", "date": "ymd"}))

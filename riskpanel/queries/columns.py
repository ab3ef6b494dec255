"""Projections, filters, conditional columns and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskpanel.functions import conditions as C
from riskpanel.functions import dates as D
from riskpanel.functions import labels as B
from riskpanel.operators import aggregates as A
from riskpanel.operators import joins as J
from riskpanel.operators import ranking as RK
from riskpanel.operators.reshape import like_columns, map_numeric
from riskpanel.queries import query
from riskpanel.queries import shared as X
from riskpanel.session import literal_table
from riskpanel.sources.commerce import table

def _n():
    return F.count(F.lit(1)).alias("n")



@query("project_rename", """SELECT o_orderkey AS id, o_custkey AS area, CAST(o_orderdate AS DATE) AS ymd,
  o_totalprice AS amount FROM orders""")
def project_rename(spark, sf_dir):
    """Rename, reorder, drop, then project to another frame's columns."""
    orders = table(spark, sf_dir, "orders").withColumnsRenamed(
        {"o_orderkey": "id", "o_custkey": "area", "o_totalprice": "amount"}
    ).withColumn("ymd", F.col("o_orderdate").cast("date")).drop("o_orderstatus")
    wanted = orders.select("id", "area", "ymd", "amount")
    return like_columns(orders, wanted)


@query("per_capita_rates", f"""WITH {X.facts_sql('member')}
SELECT f.state, f.ymd, round(coalesce(cases, 0) * 1e0 / population * 100000, 4) AS cases_per_100k,
  round(coalesce(cases, 0) * 1e0 / population * 100000 / 7, 4) AS cases_avg_per_100k,
  round(admits / 7e0 / population * 100000 * 7, 4) AS admits_weekly
FROM grid f LEFT JOIN ofacts o ON f.state = o.state AND f.ymd = o.ymd
LEFT JOIN lfacts l ON f.state = l.state AND f.ymd = l.ymd""")
def per_capita_rates(spark, sf_dir):
    from riskpanel.sources import commerce as K

    keys = ["area", "ymd"]
    joined = (K.week_grid(spark, sf_dir, "member")
              .join(K.rolled_orders(spark, sf_dir, "member", D.week_start), keys, "left")
              .join(K.rolled_lines(spark, sf_dir, "member", D.week_start), keys, "left"))
    cases = C.per_100k(F.coalesce("cases", F.lit(0)), "population")
    return X.rounded(joined.select(
        F.col("area").alias("state"), "ymd", cases.alias("cases_per_100k"), (cases / 7).alias("cases_avg_per_100k"),
        (C.per_100k(F.col("admits") / 7, "population") * 7).alias("admits_weekly"),
    ), 4)


@query("impute_suppressed", """WITH s AS (SELECT l_returnflag, l_linestatus,
  CASE WHEN l_discount = 0 THEN NULL WHEN l_quantity < 5 THEN -999999 ELSE l_quantity END AS q FROM lineitem),
i AS (SELECT l_returnflag, l_linestatus, q, CASE WHEN q < 0 THEN 2 ELSE q END AS adult,
  CASE WHEN q < 0 THEN 0.5 ELSE q END AS child, CASE WHEN q < 0 THEN 0 ELSE q END AS beds FROM s)
SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE q < 0) AS n_suppressed,
  count(*) FILTER (WHERE adult IS NULL) AS n_missing, round(sum(adult), 4) AS adult, round(sum(child), 4) AS child,
  round(sum(beds), 4) AS beds FROM i GROUP BY ALL""")
def impute_suppressed(spark, sf_dir):
    q = F.when(F.col("l_discount") != 0, F.when(F.col("l_quantity") < 5, -999999.0).otherwise(F.col("l_quantity")))
    s = table(spark, sf_dir, "lineitem").withColumns({"q": q, "adult": q, "child": q, "beds": q})
    v = C.SUPPRESSED_VALUES
    i = s.withColumns(C.impute_columns(
        {"adult": v["adult_admissions"], "child": v["paediatric_admissions"], "beds": v["beds"]}))
    return X.rounded(i.groupBy("l_returnflag", "l_linestatus").agg(
        _n(), F.count_if(F.col("q") < 0).alias("n_suppressed"), A.count_missing("adult").alias("n_missing"),
        F.sum("adult").alias("adult"), F.sum("child").alias("child"), F.sum("beds").alias("beds")), 4)


@query("outcome_band_label", f"""WITH {X.panel_sql('state')}
SELECT CASE WHEN two_zeke_time_3 THEN '>2 deaths/100K/week' WHEN zeke_time_3 AND NOT two_zeke_time_3
  THEN '1-2 deaths/100K/week' WHEN NOT zeke_time_3 AND NOT two_zeke_time_3 THEN '<1 death/100K/week' END AS band,
  quarter_label, count(*) AS n FROM panel GROUP BY ALL""")
def outcome_band_label(spark, sf_dir):
    p = X.panel(spark, sf_dir).withColumns({
        "band": B.death_band(F.col("zeke_time_3"), F.col("two_zeke_time_3")),
        "quarter_label": D.quarter_label(F.col("ymd")),
    })
    return p.groupBy("band", "quarter_label").agg(_n())


@query("safe_ratio_capped", """WITH r AS (SELECT l_suppkey,
  CASE WHEN l_quantity < 4 THEN -999999e0 ELSE l_quantity END AS num0,
  CASE WHEN l_linenumber = 1 THEN -999999e0 WHEN l_linenumber = 2 THEN 0 ELSE l_linenumber * 8e0 END AS den0
  FROM lineitem),
p AS (SELECT l_suppkey, CASE WHEN num0 >= 0 THEN num0 END AS num1, CASE WHEN den0 >= 0 THEN den0 END AS den1 FROM r),
q AS (SELECT l_suppkey, CASE WHEN den1 IS NOT NULL THEN num1 END AS num,
  CASE WHEN num1 IS NOT NULL THEN den1 END AS den FROM p),
f AS (SELECT *, coalesce(num / nullif(den, 0), 1) AS base FROM q)
SELECT l_suppkey, count(*) AS n, count(num) AS n_num, count(den) AS n_den, count(*) FILTER (WHERE base > 1) AS n_above,
  round(avg(least(base, 1)), 6) AS factor FROM f GROUP BY 1""")
def safe_ratio_capped(spark, sf_dir):
    """Confirmed share per row: sentinels and half-known pairs count as 1, anything above 1 as 1."""
    raw = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.when(F.col("l_quantity") < 4, -999999.0).otherwise(F.col("l_quantity")).alias("num"),
        F.when(F.col("l_linenumber") == 1, -999999.0).when(F.col("l_linenumber") == 2, 0.0)
        .otherwise(F.col("l_linenumber") * 8.0).alias("den"),
    )
    known = raw.withColumns({"num": C.sentinel_to_null("num"), "den": C.sentinel_to_null("den")})
    pair = known.withColumns({"num": C.null_unless("num", "den"), "den": C.null_unless("den", "num")})
    base = C.ratio_or_one("num", "den")
    return pair.groupBy("l_suppkey").agg(
        _n(), F.count("num").alias("n_num"), F.count("den").alias("n_den"), F.count_if(base > 1).alias("n_above"),
        X.rnd(F.avg(C.cap_at_one(base))).alias("factor"))


@query("fill_null_zero", f"""WITH {X.facts_sql('member')}
SELECT state, count(*) AS n, count(*) FILTER (WHERE admits_weekly IS NULL) AS n_missing,
  round(avg(coalesce(admits_weekly, 0)), 6) AS admits, round(avg(coalesce(admits_weekly / nullif(cases_weekly, 0), 0)), 6)
  AS per_case FROM facts GROUP BY state""")
def fill_null_zero(spark, sf_dir):
    p = X.panel(spark, sf_dir, "member")
    ratio = F.try_divide("admits_weekly", "cases_weekly")
    return p.groupBy("state").agg(
        _n(), A.count_missing("admits_weekly").alias("n_missing"),
        X.rnd(F.avg(C.zero_if_missing("admits_weekly"))).alias("admits"),
        X.rnd(F.avg(C.zero_if_missing(C.zero_if_infinite(ratio)))).alias("per_case"))


@query("override_patch", f"""WITH {X.facts_sql('state')},
patch AS (SELECT state, ymd, icu_weekly AS replacement FROM facts WHERE state = '7'
  AND ymd BETWEEN DATE '1999-12-05' AND DATE '2000-03-19')
SELECT f.state, f.ymd, replacement IS NOT NULL AS was_patched, round(coalesce(replacement, cases_weekly), 6) AS cases_weekly
FROM facts f LEFT JOIN patch p ON f.state = p.state AND f.ymd = p.ymd""")
def override_patch(spark, sf_dir):
    """A replacement series for one area and period wins over the reported one."""
    p = X.panel(spark, sf_dir)
    patch = p.where((F.col("state") == "7") & F.col("ymd").between("1999-12-05", "2000-03-19")).select(
        "state", "ymd", F.col("icu_weekly").alias("replacement"))
    joined = J.lookup_left(p, patch, {"state": "state", "ymd": "ymd"}, ["replacement"])
    return joined.select("state", "ymd", F.col("replacement").isNotNull().alias("was_patched"),
                         X.rnd(C.patched("replacement", "cases_weekly")).alias("cases_weekly"))


@query("filter_not_in_nullsafe", """SELECT n_name, count(*) AS n, round(sum(c_acctbal), 4) AS acctbal FROM customer
  LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON c_nationkey = n_nationkey
  WHERE coalesce(n_name NOT IN ('NATION_1', 'NATION_2', 'NATION_7'), true) GROUP BY 1""")
def filter_not_in_nullsafe(spark, sf_dir):
    """Exclusion list that keeps rows whose name is unknown."""
    known = table(spark, sf_dir, "nation").where("n_regionkey <> 3")
    named = J.lookup_left(table(spark, sf_dir, "customer"), known, {"c_nationkey": "n_nationkey"}, ["n_name"])
    kept = named.where(C.not_in("n_name", ["NATION_1", "NATION_2", "NATION_7"]))
    return X.rounded(kept.groupBy("n_name").agg(_n(), F.sum("c_acctbal").alias("acctbal")), 4)


@query("filter_date_range", f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus,
  count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders WHERE o_orderdate >= DATE '{X.START}'
  AND o_orderdate <= DATE '{X.END}' GROUP BY ALL""")
def filter_date_range(spark, sf_dir):
    """Date range on the stored column itself, so that it reaches the parquet scan."""
    d = F.col("o_orderdate")
    kept = table(spark, sf_dir, "orders").where((d >= F.lit(X.START).cast("timestamp_ntz"))
                                                & (d <= F.lit(X.END).cast("timestamp_ntz")))
    return kept.groupBy(D.month_start(d.cast("date")).alias("month"), "o_orderstatus").agg(
        _n(), X.rnd(F.sum("o_totalprice"), 2).alias("amount"))


@query("weekly_sample_dow", """SELECT CAST(o_orderdate AS DATE) AS ymd, dayname(o_orderdate) AS weekday, count(*) AS n
  FROM orders WHERE dayofweek(o_orderdate) = 3 GROUP BY ALL""")
def weekly_sample_dow(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("ymd"))
    return orders.where(D.is_wednesday(F.col("ymd"))).groupBy("ymd").agg(_n()).withColumn(
        "weekday", D.weekday_name(F.col("ymd")))


@query("distinct_values", """SELECT c_nationkey AS state, count(DISTINCT o_custkey) AS customers,
  count(DISTINCT CAST(o_orderdate AS DATE)) AS days, count(DISTINCT o_orderpriority) AS priorities
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def distinct_values(spark, sf_dir):
    """Distinct customers, days and priorities per state without expanding a row per counted column.

    A customer is one row from before the join on, with its (day, priority) pairs, which the calendar bounds; after the join its first pair counts the
    customer, and rows are summed by state and day, then by state.
    """
    pair = F.struct(F.col("o_orderdate").cast("date").alias("ymd"), F.col("o_orderpriority").alias("priority"))
    by_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(pair).alias("pairs"))
    states = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("state"))
    pairs = by_customer.join(states, F.col("o_custkey") == F.col("c_custkey")).select("state", F.posexplode("pairs").alias("i", "p"))
    days = pairs.groupBy("state", "p.ymd").agg(F.count_if(F.col("i") == 0).alias("n"), F.collect_set("p.priority").alias("priorities"))
    return days.groupBy("state").agg(
        F.sum("n").alias("customers"), F.count("ymd").alias("days"),
        F.size(F.array_distinct(F.flatten(F.collect_set("priorities")))).cast("long").alias("priorities"))


# Reporting units of the test geography: several nations -> one unit, one of them its representative.
_UNITS = {101: (5, (1, 2, 3, 4, 5)), 102: (9, (6, 7, 8, 9)), 103: (10, (10, 11)), 104: (13, (12, 13))}
_CROSSWALK = [(n, unit, n == rep) for unit, (rep, members) in _UNITS.items() for n in members]
_CROSSWALK_SQL = "cw(code, unit, keep) AS (VALUES " + ", ".join(
    f"({a}, {b}, {str(k).lower()})" for a, b, k in _CROSSWALK) + ")"


@query("area_crosswalk", f"""WITH {_CROSSWALK_SQL},
merged AS (SELECT coalesce(unit, c_nationkey) AS code, count(*) AS customers, count(DISTINCT c_nationkey) AS members,
  sum(c_acctbal) AS acctbal FROM customer LEFT JOIN cw ON c_nationkey = code GROUP BY 1),
kept AS (SELECT coalesce(unit, n_nationkey) AS code, n_name FROM nation LEFT JOIN cw ON n_nationkey = code
  WHERE coalesce(keep, true))
SELECT m.code, n_name, customers, members, round(acctbal, 4) AS acctbal FROM merged m LEFT JOIN kept k ON m.code = k.code""")
def area_crosswalk(spark, sf_dir):
    """Measures are remapped and summed; the lookup keeps one representative per unit."""
    cw = literal_table(spark, _CROSSWALK, "code int, unit int, keep boolean")
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code"), "c_nationkey", "c_acctbal")
    merged = J.remap_codes(customers, "code", cw).groupBy("code").agg(
        F.count(F.lit(1)).alias("customers"), F.countDistinct("c_nationkey").alias("members"),
        X.rnd(F.sum("c_acctbal"), 4).alias("acctbal"))
    kept = J.representatives(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "code"), "code", cw)
    return J.lookup_left(merged, kept, {"code": "code"}, ["n_name"])


@query("rule_label", """SELECT coalesce(c_mktsegment, 'NA') || ' ' || coalesce(CAST(n_regionkey AS VARCHAR), 'NA') AS label,
  count(*) AS n FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON c_nationkey = n_nationkey
  GROUP BY 1""")
def rule_label(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_regionkey <> 3")
    joined = J.lookup_left(table(spark, sf_dir, "customer"), known, {"c_nationkey": "n_nationkey"}, ["n_regionkey"])
    return joined.groupBy(B.rule_label("c_mktsegment", "n_regionkey").alias("label")).agg(_n())


@query("split_rule_label", """SELECT split_part(p_name, ' ', 1) AS first_part,
  CASE WHEN len(string_split(p_name, ' ')) > 1 THEN split_part(p_name, ' ', 2) END AS second_part,
  CASE WHEN len(string_split(p_name, ' ')) > 2 THEN split_part(p_name, ' ', 3) END AS third_part,
  count(*) AS n FROM part GROUP BY ALL""")
def split_rule_label(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        *[c.alias(k) for k, c in B.split_label(F.col("p_name"), ["first_part", "second_part", "third_part"]).items()])
    return parts.groupBy("first_part", "second_part", "third_part").agg(_n())


@query("date_parts", """SELECT event_id, CAST(ts AS DATE) AS ymd, CAST(ts AS DATE) + 5 AS plus_5, CAST(ts AS DATE) - 21 AS minus_21,
  CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(quarter(ts) AS INTEGER) AS quarter,
  CAST(date_trunc('month', ts) AS DATE) AS month_start, year(ts) || ' ' || quarter(ts) AS quarter_label,
  year(ts) || '-' || quarter(ts) AS quarter_hyphen, CAST(CAST(ts AS DATE) - INTERVAL 3 MONTH AS DATE) AS back_3m FROM events""")
def date_parts(spark, sf_dir):
    """Dates parsed from text by format, then shifted and labelled."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy/MM/dd").alias("text"))
    d = F.col("ymd")
    return e.select("event_id", F.to_date("text", "yyyy/MM/dd").alias("ymd")).select(
        "event_id", "ymd", F.date_add(d, 5).alias("plus_5"), F.date_sub(d, 21).alias("minus_21"),
        F.year(d).alias("year"), F.month(d).alias("month"), F.quarter(d).alias("quarter"),
        D.month_start(d).alias("month_start"), D.quarter_label(d).alias("quarter_label"),
        D.quarter_label(d, "-").alias("quarter_hyphen"), F.add_months(d, -3).alias("back_3m"))


@query("epi_week", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ymd FROM orders),
w AS (SELECT ymd, CAST(ceil(dayofyear(ymd + CAST(3 - dayofweek(ymd) AS INTEGER)) / 7e0) AS INTEGER) AS week FROM d)
SELECT ymd, week, year(ymd) || '-' || week AS year_wk FROM w""")
def epi_week(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("ymd")).distinct()
    return d.select("ymd", D.epi_week(F.col("ymd")).alias("week"), D.year_week(F.col("ymd")).alias("year_wk"))


@query("code_normalise", """WITH t AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'USA-unknown'
  ELSE 'USA-' || lpad(CAST(c_custkey % 97 AS VARCHAR), 5, '0') END AS geoid FROM customer)
SELECT TRY_CAST(replace(geoid, 'USA-', '') AS INTEGER) AS fips, count(*) AS n FROM t GROUP BY 1""")
def code_normalise(spark, sf_dir):
    key = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(
        F.when(key % 11 == 0, "USA-unknown")
        .otherwise(F.concat(F.lit("USA-"), F.lpad((key % 97).cast("string"), 5, "0"))).alias("geoid"))
    return t.groupBy(B.code_number(F.col("geoid"), "USA-").alias("fips")).agg(_n())


@query("round_numeric_cols", f"""WITH {X.panel_sql('state')}
SELECT state, ymd, CASE WHEN change_cases < 0 THEN 0 ELSE round_even(change_cases * 100, 0) END AS change_cases,
  CASE WHEN change_perc < 0 THEN 0 ELSE round_even(change_perc * 100, 0) END AS change_perc FROM panel""")
def round_numeric_cols(spark, sf_dir):
    """Every numeric column as a half-even percentage, clipped at 0; unknown stays unknown."""
    p = X.panel(spark, sf_dir).select("state", "ymd", "change_cases", "change_perc")
    return map_numeric(p, lambda c: C.clip_below(F.bround(c * 100, 0)))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("ordered_labels", """SELECT o_orderpriority AS label, CAST(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM',
  '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) AS INTEGER) AS label_ord,
  CAST(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) AS INTEGER)
  AS label_rev, count(*) AS n FROM orders GROUP BY ALL""")
def ordered_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(_n())
    return o.withColumns({
        "label_ord": B.ordinal(F.col("label"), _PRIORITIES),
        "label_rev": B.ordinal(F.col("label"), _PRIORITIES, reverse=True),
    }).orderBy("label_ord")


@query("regex_rule_class", """SELECT CASE WHEN regexp_matches(p_type, 'daptive|ECO') THEN 'first'
  WHEN regexp_matches(p_brand, '[05]$') THEN 'second' ELSE 'other' END AS class, count(*) AS n,
  count(*) FILTER (WHERE regexp_matches(p_name, '^(red|hot)')) AS n_named FROM part GROUP BY 1""")
def regex_rule_class(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    label = F.when(F.col("p_type").rlike("daptive|ECO"), "first").when(F.col("p_brand").rlike("[05]$"), "second")
    return p.groupBy(label.otherwise("other").alias("class")).agg(
        _n(), F.count_if(F.col("p_name").rlike("^(red|hot)")).alias("n_named"))


@query("cutoff_schedules", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ymd FROM orders),
p AS (SELECT ymd, row_number() OVER (ORDER BY ymd) AS r, count(*) OVER () AS n FROM d)
SELECT ymd, r, 5e0 AS cutoff1, 10e0 AS cutoff2, round(5e0 + 10e0 * (r - 1) / (n - 1), 6) AS cutoff3,
  round(5 + 10 / (1 + exp(-0.3e0 * (r - 40))), 6) AS cutoff4, round((20 - 0.01e0 * pow(r - 25, 2) + 10) / 2, 6) AS cutoff5,
  round(5 + 10 / (1 + exp(-0.3e0 * (r - 25))) - 5 / (1 + exp(-0.4e0 * (r - 45))), 6) AS cutoff6 FROM p""")
def cutoff_schedules(spark, sf_dir):
    """Decision cut-offs that vary over the ordered dates: constant, ramp, logistic, quadratic, two logistics."""
    from riskpanel.operators.synthetic import cutoff_schedules as schedules

    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("ymd"))
    return X.rounded(schedules(RK.ordered_positions(d, "ymd")).drop("n"))


@query("sort_multi_key", """SELECT c_nationkey, c_mktsegment, c_custkey, c_acctbal FROM customer
  ORDER BY c_nationkey, c_acctbal DESC, c_custkey""")
def sort_multi_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal").orderBy(
        F.asc("c_nationkey"), F.desc("c_acctbal"), F.asc("c_custkey"))

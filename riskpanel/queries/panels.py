"""The three cleaned panels, end to end from raw-like tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from riskpanel.functions.labels import code_number
from riskpanel.operators.joins import snapshot
from riskpanel.operators.reshape import stack
from riskpanel.plans import area_panels as AP
from riskpanel.plans.daily import CleaningRules
from riskpanel.plans.state_panel import clean_state_panel, statewide_patch
from riskpanel.queries import query
from riskpanel.queries import shared as X
from riskpanel.session import scratch_path
from riskpanel.sources import commerce_raw as W
from riskpanel.sources import schemas as SC
from riskpanel.sources import tables as IO

RULES = CleaningRules(filter_date="1999-01-01", weekly_start="1999-03-01", per=100.0, **X.LEVEL_CUTS)
STATE_RULES = CleaningRules(filter_date="1999-01-01", weekly_start=None, per=100.0, **X.LEVEL_CUTS)
_PATCH = ("7", "1999-12-05", "1999-12-19")
_DOUBLES = """POPESTIMATE2019 cases_avg_per_100k deaths_avg_per_100k admits_confirmed_avg admits_confirmed_100K icu_confirmed_avg
icu_100K perc_covid deaths_21_lag_100k icu_21_lag_100K cases_lag_21_100K admits_7_lag admits_7d_ago admits_21d_ago admits_28d_ago
deaths_21_lag_100k_14d deaths_weekly admits_weekly cases_weekly icu_weekly perc_covid_100 cfr change_admits change_perc
change_cases chk2 weight weight_alt""".split()
_OTHERS = """state ymd year week year_wk dotw cdc_flag_1 cdc_flag_2 cdc_flag half_zeke_time_3 zeke_time_3 two_zeke_time_3
icu_2_time_3 perc_covid_10_time_3 zeke_time_3_14d two_zeke_time_3_14d""".split()
COLUMNS = _OTHERS + _DOUBLES

_FIPS = ("c_nationkey * 1000 + list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) "
         "* 10 + c_custkey % 4")
_BASE = f"""cty AS (SELECT c_custkey, c_nationkey, CAST({_FIPS} AS INTEGER) AS fips, CAST(({_FIPS}) // 1000 * 10 +
  ({_FIPS}) // 10 % 100 AS INTEGER) AS hsa FROM customer),
days AS (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS day FROM orders),
od AS (SELECT c_nationkey, fips, hsa, CAST(o_orderdate AS DATE) AS day, count(*) AS n,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent
  FROM orders JOIN cty ON o_custkey = c_custkey GROUP BY ALL),
li AS (SELECT c_nationkey, fips, hsa, CAST(l_shipdate AS DATE) AS day, l_returnflag AS f, l_quantity AS q, l_discount AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cty ON o_custkey = c_custkey)"""
_LINE_AGG = """count(*) FILTER (WHERE f = 'R') AS n_r, count(*) FILTER (WHERE f = 'A') AS n_a,
  count(*) FILTER (WHERE f = 'N') AS n_n, sum(q) FILTER (WHERE f = 'N') AS q_n, sum(q) FILTER (WHERE f <> 'N') AS q_ra,
  sum(q) AS q, count(*) FILTER (WHERE q >= 25) AS n_big, count(*) AS n_lines, avg(d) AS disc"""


def _weekly_sql(start: str | None, icu_days: int) -> str:
    """From CTE ``d`` (area, ymd, pop, rates and hospital columns) to the weekly panel ``p``."""
    sample = "dayofweek(ymd) = 3 AND ymd >= DATE '1999-01-01'" + (f" AND ymd >= DATE '{start}'" if start else "")
    return f"""f AS (SELECT *,
  (cases_avg_per_100k > 3 / 7e0 AND (admits_confirmed_100K > 4 / 7e0 OR perc_covid > 0.1e0)) AS cdc_flag_1,
  (cases_avg_per_100k < 3 / 7e0 AND (admits_confirmed_100K > 6 / 7e0 OR perc_covid > 0.15e0)) AS cdc_flag_2,
  lead(deaths_avg_per_100k, 21) OVER w AS deaths_21_lag_100k, lead(icu_100K, 21) OVER w AS icu_21_lag_100K,
  lag(cases_avg_per_100k, 21) OVER w AS cases_lag_21_100K, lead(admits_confirmed_avg, 7) OVER w AS admits_7_lag,
  lag(admits_confirmed_avg, 7) OVER w AS admits_7d_ago, lag(admits_confirmed_avg, 21) OVER w AS admits_21d_ago,
  lag(admits_confirmed_avg, 28) OVER w AS admits_28d_ago FROM d WINDOW w AS (PARTITION BY area ORDER BY ymd)),
wk AS (SELECT *, cdc_flag_1 OR cdc_flag_2 AS cdc_flag, CAST(year(ymd) AS INTEGER) AS year,
  CAST(ceil(dayofyear(ymd + CAST(3 - dayofweek(ymd) AS INTEGER)) / 7e0) AS INTEGER) AS week, dayname(ymd) AS dotw,
  CASE WHEN row_number() OVER w >= 2 THEN avg(deaths_21_lag_100k) OVER (PARTITION BY area ORDER BY ymd ROWS 1 PRECEDING) * 14
    END AS deaths_21_lag_100k_14d,
  deaths_21_lag_100k * 7 AS deaths_weekly, admits_confirmed_100K * 7 AS admits_weekly, icu_100K * {icu_days} AS icu_weekly,
  round_even(cases_avg_per_100k * 7, 0) AS cases_weekly,
  deaths_avg_per_100k / nullif(cases_lag_21_100K, 0) * 100 AS cfr, perc_covid * 100 AS perc_covid_100
  FROM f WHERE {sample} WINDOW w AS (PARTITION BY area ORDER BY ymd)),
p AS (SELECT *, area AS state, pop AS POPESTIMATE2019, year || '-' || week AS year_wk,
  lead(deaths_avg_per_100k * 7, 3) OVER w > 0.5 AS half_zeke_time_3, lead(deaths_avg_per_100k * 7, 3) OVER w > 1 AS zeke_time_3,
  lead(deaths_avg_per_100k * 7, 3) OVER w > 2 AS two_zeke_time_3, lead(deaths_avg_per_100k, 3) OVER w AS chk2,
  icu_21_lag_100K * {icu_days} > 2 AS icu_2_time_3, lead(perc_covid_100, 3) OVER w > 10 AS perc_covid_10_time_3,
  admits_weekly - lag(admits_weekly) OVER w AS change_admits, perc_covid_100 - lag(perc_covid_100) OVER w AS change_perc,
  cases_weekly - lag(cases_weekly) OVER w AS change_cases, deaths_21_lag_100k_14d > 2 AS zeke_time_3_14d,
  deaths_21_lag_100k_14d > 4 AS two_zeke_time_3_14d, pop * 1e0 / sum(pop) OVER (PARTITION BY ymd) AS weight,
  1e0 / count(*) OVER (PARTITION BY ymd) AS weight_alt FROM wk WINDOW w AS (PARTITION BY area ORDER BY ymd))"""


def _out(df, *more):
    return X.rounded(df.select(*COLUMNS, *more), 8)


_SELECT = ", ".join(_OTHERS) + ", " + ", ".join(
    c if c == "POPESTIMATE2019" else f"round({c}, 8) AS {c}" for c in _DOUBLES)


def _roll7(c: str, strict: bool = False) -> str:
    w = "OVER (PARTITION BY k ORDER BY day ROWS 6 PRECEDING)"
    full = f"count(*) {w} = 7" + (f" AND count({c}) {w} = 7" if strict else "")
    return f"CASE WHEN {full} THEN avg({c}) {w} END"


RAW_TABLES = ("hospital_days", "state_cases", "state_census", "statewide_report", "hospital_weeks", "county_cases",
              "service_areas", "county_census")


def raw(spark, sf_dir, name):
    """A raw-like table, written once: the cleaning plans start from stored files, as they do on real data."""
    return X.stored(spark, f"raw_{name}", sf_dir, build=lambda: getattr(W, name)(spark, sf_dir))


def areas(spark, sf_dir):
    """The wanted publication of the county-to-area lookup, with numeric county codes."""
    lookup = raw(spark, sf_dir, "service_areas")
    one = snapshot(lookup, F.to_date("date_updated", "yyyy-MM-dd"), date(2022, 5, 6))
    return one.withColumn("fips", code_number(F.col("county_fips")))


@query("panel_state", f"""WITH {_BASE},
pops AS (SELECT c_nationkey AS k, count(*) AS pop FROM cty GROUP BY 1),
l AS (SELECT c_nationkey AS k, day, {_LINE_AGG} FROM li GROUP BY 1, 2),
o AS (SELECT c_nationkey AS k, day, sum(n) AS n, sum(n_f) AS n_f, sum(n_urgent) AS n_urgent FROM od GROUP BY 1, 2),
h0 AS (SELECT p.k, days.day, n_r + n_a AS admits, n_big AS icu, disc AS pct,
  CASE WHEN n_lines = 1 THEN NULL ELSE q END + n_lines AS den0, CASE WHEN n_a = 2 THEN NULL ELSE q_ra END + n_r AS num0
  FROM pops p CROSS JOIN days LEFT JOIN l ON l.k = p.k AND l.day = days.day),
h1 AS (SELECT *, CASE WHEN den0 IS NOT NULL THEN num0 END AS num, CASE WHEN num0 IS NOT NULL THEN den0 END AS den FROM h0),
h2 AS (SELECT *, coalesce(num / nullif(den, 0), 1) AS base FROM h1),
h3 AS (SELECT *, pct * least(base, 1) AS share FROM h2),
h AS (SELECT k, day, {_roll7('admits')} AS admits_confirmed_avg, {_roll7('icu')} AS icu_confirmed_avg,
  {_roll7('share')} AS perc_covid FROM h3),
d AS (SELECT 'NATION_' || p.k AS area, days.day AS ymd, pop,
  CASE WHEN p.k = 7 AND days.day BETWEEN DATE '{_PATCH[1]}' AND DATE '{_PATCH[2]}' THEN coalesce(n_urgent, 0) * 100e0 / pop
    ELSE coalesce(n, 0) * 100e0 / pop END AS cases_avg_per_100k,
  coalesce(n_f, 0) * 100e0 / pop AS deaths_avg_per_100k, admits_confirmed_avg, icu_confirmed_avg,
  coalesce(perc_covid, 0) AS perc_covid, admits_confirmed_avg / pop * 100 AS admits_confirmed_100K,
  icu_confirmed_avg / pop * 100 AS icu_100K
  FROM pops p CROSS JOIN days LEFT JOIN o ON o.k = p.k AND o.day = days.day
  LEFT JOIN h ON h.k = p.k AND h.day = days.day AND h.day >= DATE '1999-01-01' WHERE p.k NOT IN (23, 24)),
{_weekly_sql(None, 1)}
SELECT {_SELECT}, round(deaths_weekly / nullif(cases_weekly, 0) * 100, 8) AS cfr_in_21d,
  deaths_avg_per_100k * 7 > 1 AS zeke_time_0, deaths_avg_per_100k * 7 > 2 AS two_zeke_time_0 FROM p""")
def panel_state(spark, sf_dir):
    patch = statewide_patch(raw(spark, sf_dir, "statewide_report"), f"NATION_{_PATCH[0]}", _PATCH[1], _PATCH[2])
    panel = clean_state_panel(
        raw(spark, sf_dir, "hospital_days"), raw(spark, sf_dir, "state_cases"), raw(spark, sf_dir, "state_census"), patch, STATE_RULES,
        excluded=["NATION_23"])
    return _out(panel, "cfr_in_21d", "zeke_time_0", "two_zeke_time_0")


_HSA_WEEKS = f"""pops AS (SELECT hsa, count(*) AS pop FROM cty GROUP BY 1),
hl AS (SELECT hsa, fips, day - CAST((dayofweek(day) + 2) % 7 AS INTEGER) + 5 AS wed, {_LINE_AGG} FROM li GROUP BY 1, 2, 3),
hs AS (SELECT hl.hsa, pop, wed,
  (coalesce(sum(CASE WHEN n_r = 1 THEN 2 ELSE n_r END), 0) + coalesce(sum(CASE WHEN n_a = 1 THEN 0.5 WHEN n_a > 1 THEN n_a END), 0)) / 7e0
    AS admits_confirmed_avg,
  coalesce(sum(n_n + CASE WHEN q_n < 10 THEN 0 ELSE q_n END), 0) AS covid,
  coalesce(sum(CASE WHEN n_lines = 1 THEN 0 ELSE q END), 0) AS beds,
  coalesce(sum(CASE WHEN n_big = 1 THEN 0.5 ELSE n_big END), 0) / 7e0 AS icu_confirmed_avg
  FROM hl JOIN pops ON hl.hsa = pops.hsa GROUP BY 1, 2, 3),
h AS (SELECT hsa, wed, admits_confirmed_avg, icu_confirmed_avg, covid / 7e0 / nullif(beds, 0) AS perc,
  admits_confirmed_avg / pop * 100 AS a100, icu_confirmed_avg / pop * 100 / 7 AS icu_100K FROM hs)"""


GROUP_SQL = f"""WITH {_BASE}, {_HSA_WEEKS},
o AS (SELECT hsa, day, sum(n) AS n, sum(n_f) AS n_f FROM od WHERE fips <> {W.UNKNOWN_COUNTY} GROUP BY 1, 2),
d AS (SELECT p.hsa AS area, days.day AS ymd, pop, coalesce(n, 0) * 1e0 / pop * 100 AS cases_avg_per_100k,
  coalesce(n_f, 0) * 1e0 / pop * 100 AS deaths_avg_per_100k, admits_confirmed_avg, icu_confirmed_avg,
  coalesce(perc, 0) AS perc_covid, coalesce(a100, 0) AS admits_confirmed_100K, icu_100K
  FROM pops p CROSS JOIN days LEFT JOIN o ON o.hsa = p.hsa AND o.day = days.day
  LEFT JOIN h ON h.hsa = p.hsa AND h.wed = days.day AND h.wed >= DATE '1999-01-01'
  WHERE p.hsa // 10 <> 23),
r AS (SELECT DISTINCT pop AS rp, rank() OVER (ORDER BY pop DESC) + (count(*) OVER (PARTITION BY pop) - 1) / 2e0 AS county_rank
  FROM d WHERE ymd >= DATE '1999-01-01'),
{_weekly_sql('1999-03-01', 7)}
SELECT {_SELECT}, county_rank FROM p JOIN r ON pop = rp"""


@query("panel_group", GROUP_SQL)
def panel_group(spark, sf_dir):
    panel = AP.clean_group_panel(
        raw(spark, sf_dir, "hospital_weeks"), raw(spark, sf_dir, "county_cases"), areas(spark, sf_dir), RULES, W.UNITS,
        excluded=["NATION_23"])
    return _out(panel, "county_rank")


@query("panel_member", f"""WITH {_BASE}, {_HSA_WEEKS},
unit AS (SELECT *, CASE WHEN fips BETWEEN 1010 AND 1013 THEN 9001 WHEN fips BETWEEN 2010 AND 2013 THEN 9002 ELSE fips END AS code
  FROM cty),
cpop AS (SELECT code, count(*) AS pop, min(hsa) AS hsa FROM unit GROUP BY 1),
o AS (SELECT code, day, sum(n) AS n, sum(n_f) AS n_f FROM od JOIN (SELECT DISTINCT fips, code FROM unit) u ON od.fips = u.fips
  GROUP BY 1, 2),
d AS (SELECT p.code AS area, days.day AS ymd, p.pop, coalesce(n, 0) * 1e0 / p.pop * 100 AS cases_avg_per_100k,
  coalesce(n_f, 0) * 1e0 / p.pop * 100 AS deaths_avg_per_100k, admits_confirmed_avg, icu_confirmed_avg,
  coalesce(perc, 0) AS perc_covid, coalesce(a100, 0) AS admits_confirmed_100K, icu_100K
  FROM cpop p CROSS JOIN days LEFT JOIN o ON o.code = p.code AND o.day = days.day
  LEFT JOIN h ON h.hsa = p.hsa AND h.wed = days.day AND h.wed > DATE '1999-01-01'
  WHERE p.hsa // 10 <> 23 AND p.code <> {W.UNKNOWN_COUNTY}),
r AS (SELECT DISTINCT pop AS rp, rank() OVER (ORDER BY pop DESC) + (count(*) OVER (PARTITION BY pop) - 1) / 2e0 AS county_rank
  FROM d WHERE ymd >= DATE '1999-01-01'),
{_weekly_sql('1999-03-01', 7)}
SELECT {_SELECT}, county_rank FROM p JOIN r ON pop = rp WHERE state NOT IN (4010, 4020)""")
def panel_member(spark, sf_dir):
    panel = AP.clean_member_panel(
        raw(spark, sf_dir, "hospital_weeks"), raw(spark, sf_dir, "county_cases"), areas(spark, sf_dir), raw(spark, sf_dir, "county_census"),
        RULES, W.UNITS, excluded=["NATION_23"], without_group=[4010, 4020])
    return _out(panel, "county_rank")


# Raw files with the schema each is declared with, and the correction reports in them that hold a text where a number belongs: in which rows, in which column.
_FILES = {
    "hospital_weeks": (SC.HOSPITAL_WEEKLY, "endswith(collection_week, '/01')", "inpatient_beds_7_day_avg"),
    "county_cases": (SC.COUNTY_CASES, "endswith(date, '-01-01')", "cases_avg"),
    "service_areas": (SC.SERVICE_AREAS, "false", "county_population"),
}
_DATED = {"hospital_weeks": "collection_week", "county_cases": "date"}


def ingested(spark, sf_dir, name):
    """Path of a raw table that went out as CSV, one folder per year, broken correction reports included, and was read in through its declared schema."""
    schema, broken, column = _FILES[name]

    def write(path):
        rows = raw(spark, sf_dir, name)
        text = rows.select(*[F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in schema.names])
        lines = text.unionByName(text.where(broken).withColumn(column, F.lit("pending")))
        files = scratch_path(spark, f"csv_{name}")
        if name in _DATED:
            lines.withColumn("y", F.substring(_DATED[name], 1, 4)).write.partitionBy("y").option("header", True).csv(files)
        else:
            IO.write_csv(lines, files)
        IO.ingest_csv(spark, files, schema, path)

    return X.stored_at(spark, f"ingested_{name}", sf_dir, write=write)


def from_csv(spark, sf_dir, name):
    return IO.read_ingested(spark, ingested(spark, sf_dir, name), _FILES[name][0])


@query("panel_from_csv", GROUP_SQL)
def panel_from_csv(spark, sf_dir):
    """The group panel from raw CSV files of several years. Broken lines are set apart, so the panel equals the one from the tables."""
    one = snapshot(from_csv(spark, sf_dir, "service_areas"), F.to_date("date_updated", "yyyy-MM-dd"), date(2022, 5, 6))
    panel = AP.clean_group_panel(
        from_csv(spark, sf_dir, "hospital_weeks"), from_csv(spark, sf_dir, "county_cases"),
        one.withColumn("fips", code_number(F.col("county_fips"))), RULES, W.UNITS, excluded=["NATION_23"])
    return _out(panel, "county_rank")


@query("raw_quarantine", f"""WITH {_BASE},
h AS (SELECT DISTINCT fips, day - CAST((dayofweek(day) + 2) % 7 AS INTEGER) AS d FROM li),
c AS (SELECT code, day AS d FROM days CROSS JOIN (SELECT DISTINCT c_nationkey, CASE WHEN fips BETWEEN 1010 AND 1013 THEN {W.REPORTED_TOGETHER}
  WHEN fips = {W.UNKNOWN_COUNTY} THEN 99999 ELSE fips END AS code FROM cty))
SELECT 'hospital_weeks' AS source, CAST(year(d) AS VARCHAR) AS year, count(*) AS n_rows, count(*) FILTER (WHERE day(d) = 1) AS n_broken,
  count(DISTINCT fips) FILTER (WHERE day(d) = 1) AS n_broken_areas FROM h GROUP BY ALL
UNION ALL SELECT 'county_cases', CAST(year(d) AS VARCHAR), count(*), count(*) FILTER (WHERE day(d) = 1 AND month(d) = 1),
  count(DISTINCT code) FILTER (WHERE day(d) = 1 AND month(d) = 1) FROM c GROUP BY ALL""")
def raw_quarantine(spark, sf_dir):
    """Rows that were read and lines that were set apart, by raw table and year. What a broken line says of its area and date is taken from its text."""
    parts = []
    for name, dated in _DATED.items():
        path, schema = ingested(spark, sf_dir, name), _FILES[name][0]
        area = "fips_code" if name == "hospital_weeks" else "geoid"
        fields = F.split(IO.LINE, ",")
        lines = IO.read_quarantine(spark, path, schema).select(
            F.get(fields, F.lit(schema.names.index(dated))).alias("d"), F.get(fields, F.lit(schema.names.index(area))).alias("broken"))
        good = IO.read_ingested(spark, path, schema).select(F.col(dated).alias("d"), F.lit(None).cast("string").alias("broken"))
        both = good.unionByName(lines).groupBy(F.substring("d", 1, 4).alias("year"), "broken").agg(F.count(F.lit(1)).alias("n"))
        parts.append(both.groupBy(F.lit(name).alias("source"), "year").agg(
            F.coalesce(F.sum(F.when(F.col("broken").isNull(), F.col("n"))), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("broken").isNotNull(), F.col("n"))), F.lit(0)).alias("n_broken"), F.count("broken").alias("n_broken_areas")))
    return stack(parts)

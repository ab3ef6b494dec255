"""What several queries share: the study parameters on the test tables, stored panels, and SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riskpanel.functions.labels import SPEC_NAMES
from riskpanel.operators.quality import watched
from riskpanel.operators.rules import Grid
from riskpanel.plans.weekly import label_weekly
from riskpanel.session import materialize, scratch_path
from riskpanel.sources.commerce import weekly_facts

# Study design on the test tables.
START, END, SPLIT = "2000-01-01", "2001-06-30", "2000-12-31"
CASES, ADMITS, BEDS = (2.0, 3.0, 4.0), (2.0, 4.0, 6.0), (5.0, 10.0, 25.0)
LEVEL_CUTS = {"case_cut": 3 / 7, "low": (4 / 7, 0.10), "high": (6 / 7, 0.15)}
GRIDS = {
    "H": Grid(admit=ADMITS, kind="H"),
    "C": Grid(case=CASES, kind="C"),
    "CH": Grid(case=CASES, admit=ADMITS, kind="CH"),
    "HO": Grid(admit=ADMITS, perc=BEDS, kind="HO"),
    "CHO": Grid(case=CASES, admit=ADMITS, perc=BEDS, kind="CHO"),
}
PREVALENCE = Grid(kind="Prev")
TRAIN_QUARTERS = ["2000 1", "2000 2", "2000 3", "2000 4"]
TEST_QUARTERS = ["2001 1", "2001 2"]

_stored: dict[tuple[str, ...], DataFrame] = {}
_paths: dict[tuple[str, ...], str] = {}
_seen: dict[tuple[str, ...], Observation] = {}
WATCHED = ("cases_weekly", "admits_weekly", "icu_weekly", "perc_covid_100", "deaths_weekly")


def stored(spark: SparkSession, *key: str, build) -> DataFrame:
    """A table built once per application and kept in the shared folder, as a pipeline keeps its cleaned panel."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _stored:
        _stored[full] = materialize(build(), "_".join(key[:1]))
    return _stored[full]


def stored_at(spark: SparkSession, *key: str, write) -> str:
    """The path of a dataset that ``write(path)`` fills once per application."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _paths:
        path = scratch_path(spark, key[0])
        write(path)
        _paths[full] = path
    return _paths[full]


def panel(spark: SparkSession, sf_dir: str, level: str = "state") -> DataFrame:
    """The labelled weekly panel of one geography. Its rows, NULLs and ranges are counted while it is written."""
    def build() -> DataFrame:
        rows, seen = watched(label_weekly(weekly_facts(spark, sf_dir, level), **LEVEL_CUTS), WATCHED)
        _seen[spark.sparkContext.applicationId, level, sf_dir] = seen
        return rows

    return stored(spark, f"panel_{level}", sf_dir, build=build)


def panel_counts(spark: SparkSession, sf_dir: str, level: str = "state") -> dict:
    """What was counted while the panel was written."""
    panel(spark, sf_dir, level)
    return _seen[spark.sparkContext.applicationId, level, sf_dir].get


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded, because the order of a floating sum is not fixed."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


AREA_SQL = {
    "state": "CAST(c_nationkey AS VARCHAR)",
    "group": "c_nationkey || '-' || c_mktsegment",
    "member": "c_nationkey || '-' || c_mktsegment || '-' || (c_custkey % 4)",
}


def facts_sql(level: str = "state") -> str:
    """CTEs (without WITH) that end in ``facts``: the dense weekly table of rates."""
    return f"""
cust AS (SELECT c_custkey, {AREA_SQL[level]} AS state FROM customer),
pop AS (SELECT state, count(*) AS population FROM cust GROUP BY 1),
wk AS (SELECT CAST(unnest(generate_series(date_trunc('week', min(o_orderdate)), date_trunc('week', max(o_orderdate)),
       INTERVAL 7 DAY)) AS DATE) AS ymd FROM orders),
grid AS (SELECT state, population, ymd FROM pop CROSS JOIN wk),
ofacts AS (SELECT state, CAST(date_trunc('week', o_orderdate) AS DATE) AS ymd, count(*) AS cases,
      count(*) FILTER (WHERE o_orderstatus = 'F') AS deaths,
      count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
      FROM orders JOIN cust ON o_custkey = c_custkey GROUP BY 1, 2),
lfacts AS (SELECT state, CAST(date_trunc('week', l_shipdate) AS DATE) AS ymd,
      count(*) FILTER (WHERE l_returnflag = 'R') AS admits, sum(l_quantity) AS icu
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey GROUP BY 1, 2),
facts AS MATERIALIZED (SELECT g.state, g.ymd, g.population AS POPESTIMATE2019,
      coalesce(cases, 0) * 100e0 / population AS cases_weekly,
      coalesce(deaths, 0) * 100e0 / population AS deaths_now_weekly,
      coalesce(urgent * 1e0 / cases, 0) * 100 AS perc_covid_100,
      admits * 100e0 / population AS admits_weekly,
      icu / population AS icu_weekly
      FROM grid g LEFT JOIN ofacts o ON g.state = o.state AND g.ymd = o.ymd
                  LEFT JOIN lfacts l ON g.state = l.state AND g.ymd = l.ymd)"""


def panel_sql(level: str = "state") -> str:
    """CTEs that end in ``panel``: labels, changes, the published level and weights."""
    return facts_sql(level) + """,
labelled AS (SELECT *,
      lead(deaths_now_weekly, 3) OVER w AS deaths_weekly,
      lead(deaths_now_weekly, 3) OVER w > 0.5 AS half_zeke_time_3,
      lead(deaths_now_weekly, 3) OVER w > 1 AS zeke_time_3,
      lead(deaths_now_weekly, 3) OVER w > 2 AS two_zeke_time_3,
      lead(icu_weekly, 3) OVER w > 2 AS icu_2_time_3,
      lead(perc_covid_100, 3) OVER w > 10 AS perc_covid_10_time_3,
      admits_weekly - lag(admits_weekly, 1) OVER w AS change_admits,
      perc_covid_100 - lag(perc_covid_100, 1) OVER w AS change_perc,
      cases_weekly - lag(cases_weekly, 1) OVER w AS change_cases,
      (cases_weekly / 7 > 3 / 7e0 AND (admits_weekly / 7 > 4 / 7e0 OR perc_covid_100 / 100 > 0.1e0)) AS cdc_flag_1,
      (cases_weekly / 7 < 3 / 7e0 AND (admits_weekly / 7 > 6 / 7e0 OR perc_covid_100 / 100 > 0.15e0)) AS cdc_flag_2
      FROM facts WINDOW w AS (PARTITION BY state ORDER BY ymd)),
panel AS MATERIALIZED (SELECT *, cdc_flag_1 OR cdc_flag_2 AS cdc_flag,
      POPESTIMATE2019 * 1e0 / sum(POPESTIMATE2019) OVER (PARTITION BY ymd) AS weight,
      1e0 / count(*) OVER (PARTITION BY ymd) AS weight_alt,
      year(ymd) || ' ' || quarter(ymd) AS quarter_label
      FROM labelled)"""


def outcomes_sql(outcomes=("zeke_time_3", "two_zeke_time_3", "icu_2_time_3", "perc_covid_10_time_3")) -> str:
    """CTEs that end in ``long``: one row per panel row and outcome."""
    rule_state = {
        "zeke_time_3": "deaths_now_weekly > 1", "two_zeke_time_3": "deaths_now_weekly > 2",
        "icu_2_time_3": "icu_weekly > 2",
    }
    cov_state = rule_state | {"perc_covid_10_time_3": "perc_covid_100 > 10"}
    parts = " UNION ALL ".join(
        f"SELECT *, '{o}' AS outcome_label, CAST({o} AS DOUBLE) AS y, "
        f"CASE WHEN {rule_state.get(o, 'false')} THEN 1e0 ELSE 0e0 END AS z_rule, "
        f"CASE WHEN {cov_state.get(o, 'false')} THEN 1e0 ELSE 0e0 END AS z_cov FROM panel"
        for o in outcomes
    )
    return f"long AS MATERIALIZED ({parts})"


def grid_sql(grids=None) -> str:
    """``grid_rules``: every cell of the grids with its label."""
    rows = [
        f"('{g.kind}', '{g.label(c)}', {c[0]}e0, {c[1]}e0, {c[2]}e0)"
        for g in (grids or GRIDS.values()) for c in g.cells()
    ]
    return f"grid_rules(type, var, c, a, p) AS (VALUES {', '.join(rows)})"


IN_RANGE = f"ymd BETWEEN DATE '{START}' AND DATE '{END}'"


def confusion_sql(source: str, by: str, mult: str = "1e0") -> str:
    """SELECT of all metrics from ``source`` with columns weight, y, v (0/1/NULL)."""
    w = "weight"

    def s(cond: str, scale: str = "1") -> str:
        return f"coalesce(sum(CASE WHEN {cond} THEN {w} * {scale} END), 0)"

    a = f"(({mult} - 1) / (1 + {mult}))"
    fn, fp = s("y = 1 AND v = 0", f"(1 + {a})"), s("y = 0 AND v = 1", f"(1 - {a})")
    pos, neg = s("v = 1"), s("v = 0")
    tp, tn = s("y = 1 AND v = 1"), s("y = 0 AND v = 0")
    return f"""SELECT {by}, count(*) AS n,
      {tp} / nullif({s('y = 1 AND v IS NOT NULL')}, 0) AS sens,
      {tn} / nullif({s('y = 0 AND v IS NOT NULL')}, 0) AS spec,
      {tp} / nullif({s('v = 1 AND y IS NOT NULL')}, 0) AS ppv,
      {tn} / nullif({s('v = 0 AND y IS NOT NULL')}, 0) AS npv,
      {s('v = y')} / nullif({s('v IS NOT NULL AND y IS NOT NULL')}, 0) AS percright,
      CASE WHEN count(weight) = count(*) THEN sum(weight) END AS n2,
      {fn} AS fn, {fp} AS fp, {tn} AS tn, {tp} AS tp, {pos} AS pos, {neg} AS neg,
      1 - ({fn} + {fp}) / nullif({pos} + {neg}, 0) AS w_acc
      FROM {source} GROUP BY {by}"""


METRIC_COLUMNS = "sens spec ppv npv percright n2 fn fp tn tp pos neg w_acc".split()


def rounded_sql(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


LAB2_SQL = (
    "CASE outcome_label WHEN 'zeke_time_3' THEN '>1 death/100K/wk' WHEN 'two_zeke_time_3' THEN '>2 deaths/100K/wk' "
    "WHEN 'icu_2_time_3' THEN '>2 ICU patients/100K/wk' WHEN 'perc_covid_10_time_3' "
    "THEN '>10% inpatient bed occupancy' END"
)
def spec_name_sql(c: str = "var") -> str:
    """A specification's display name."""
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPEC_NAMES.items()) + f" ELSE {c} END"


PREFS_SQL = (
    "prefs(lab, mult) AS (VALUES ('Neutral', 1e0), ('Don''t cry wolf (0.5x FN)', 0.5e0), "
    "('Better safe than sorry (0.5x FP)', 2e0))"
)


def rule_values_sql(grids=None, fixed: bool = True, first_kind: str = "H") -> str:
    """CTEs that end in ``valued``: long x rule with three-valued v, in the evaluation range."""
    fixed_rows = f"""
      UNION ALL SELECT '{first_kind}', 'cdc_flag', ymd, quarter_label, outcome_label, weight, y,
        CAST(cdc_flag AS DOUBLE) FROM long WHERE {IN_RANGE}
      UNION ALL SELECT '{first_kind}', 'current_zeke', ymd, quarter_label, outcome_label, weight, y, z_rule
        FROM long WHERE {IN_RANGE}""" if fixed else ""
    return grid_sql(grids) + f""",
valued AS (SELECT type, var, ymd, quarter_label, outcome_label, weight, y,
      CAST(cases_weekly >= c AND admits_weekly >= a AND perc_covid_100 >= p AS DOUBLE) AS v
      FROM long CROSS JOIN grid_rules WHERE {IN_RANGE}{fixed_rows})"""


PERIODS_SQL = f"""(SELECT *, unnest(['Overall', quarter_label,
      CASE WHEN ymd > DATE '{SPLIT}' THEN 'Test' ELSE 'Training' END]) AS quarter FROM valued)"""


def metrics_long_sql(grids=None, fixed: bool = True) -> str:
    """CTEs that end in ``metric_rows``: weighted accuracy and the other rates per rule, period and preference."""
    by = "type, var, outcome_label, quarter, lab, mult"
    return (
        f"WITH {panel_sql()}, {outcomes_sql()}, {rule_values_sql(grids, fixed)}, {PREFS_SQL}, "
        f"metrics AS MATERIALIZED ({confusion_sql(PERIODS_SQL + ' CROSS JOIN prefs', by, 'mult')}), "
        f"metric_rows AS MATERIALIZED (SELECT type, CASE var WHEN 'cdc_flag' THEN 'Community level' "
        f"WHEN 'current_zeke' THEN 'Z' ELSE var END AS var, "
        f"CASE WHEN var IN ('cdc_flag', 'current_zeke') THEN 'baseline' ELSE 'static' END AS rule_kind, "
        f"outcome_label, {LAB2_SQL} AS lab2, quarter, lab, mult, sens, spec, ppv, npv, percright, w_acc FROM metrics)"
    )

"""Registered queries: the entry point, naming, and Spark against SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry  # noqa: E402
from check_queries import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
# Kept out of the quick run: these need the fits of every specification.
SLOW = {"rf_variant", "rf_audit", "analysis_matrix", "analysis_matrix_static", "adaptive_glm_fit", "adaptive_glm_score", "threshold_by_cost", "adaptive_quarterly", "adaptive_multi_fit",
        "roc_sweep", "adaptive_metrics", "best_static_table", "max_regret", "max_regret_adaptive", "quarter_table",
        "time_trend_table", "pivot_periods", "arg_best_rule", "agg_of_agg", "pareto_dominance", "roc_points",
        "switch_summary", "prediction_calendar"}
ORACLES = entry.oracle_sql()
OPTIONAL = set(entry.llm.QUERIES) if entry.llm else set()  # these have tests of their own


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"var", "quarter", "w_acc"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
    assert set(entry.queries()) - set(ORACLES) - OPTIONAL == {
        "analysis_matrix", "rf_variant"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW - OPTIONAL))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    order = [list(rel.columns).index(c) for c in cols]
    assert sorted(rel.columns) == cols
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert compare(got, [tuple(r[i] for i in order) for r in rel.fetchall()]) == ""

"""Column functions against hand-written expectations."""

from datetime import date

from pyspark.sql import functions as F

from riskpanel.functions import conditions as C
from riskpanel.functions import dates as D
from riskpanel.functions import labels as B
from riskpanel.functions.series import by_area, rolling_mean
from riskpanel.session import literal_table


def _one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_epi_week_around_new_year(spark):
    days = [date(2014, 12, 31), date(2015, 1, 4), date(2021, 1, 2), date(2022, 1, 1), date(2021, 4, 7)]
    df = literal_table(spark, [(d,) for d in days], "d date")
    assert _one(df, D.epi_week(F.col("d")), D.year_week(F.col("d"))) == [
        (53, "2014-53"), (1, "2015-1"), (53, "2021-53"), (52, "2022-52"), (14, "2021-14")]


def test_null_rules(spark):
    df = literal_table(spark, [(-999999.0, "a"), (3.0, None), (None, "b"), (float("nan"), "a")], "x double, s string")
    assert _one(df.where("not isnan(x) or x is null"), C.impute_suppressed("x", 2.0)) == [(2.0,), (3.0,), (None,)]
    assert _one(df, C.zero_if_missing("x")) == [(-999999.0,), (3.0,), (0.0,), (0.0,)]
    # A NULL name is not in the exclusion list, so its row stays.
    assert df.where(C.not_in("s", ["a"])).count() == 2
    assert _one(df, C.update_where("x", F.col("s") == "b", F.lit(1.0)))[1:3] == [(3.0,), (1.0,)]
    assert _one(df, C.if_else(F.col("s") == "a", F.lit(1), F.lit(2))) == [(1,), (None,), (2,), (1,)]


def test_safe_ratio(spark):
    df = literal_table(spark, [(4.0, 2.0), (1.0, 0.0), (None, 3.0), (1.0, 4.0)], "n double, d double")
    assert _one(df, C.cap_at_one(C.ratio_or_one("n", "d"))) == [(1.0,), (1.0,), (1.0,), (0.25,)]


def test_community_level_is_strict_on_the_case_cut(spark):
    cut = 200 / 7
    df = literal_table(spark, [(cut, 99.0, 1.0), (cut + 1, 2.0, 0.0), (cut - 1, 2.0, 0.0), (cut - 1, 2.9, 0.0),
                               (cut + 1, None, 0.0)], "c double, h double, o double")
    above, below = C.community_level_parts(F.col("c"), F.col("h"), F.col("o"))
    assert _one(df, above | below) == [(False,), (True,), (False,), (True,), (None,)]


def test_labels(spark):
    df = literal_table(spark, [("50 5 0", "USA-00036"), ("Z", "USA-x")], "v string, g string")
    parts = B.split_label(F.col("v"), ["c", "h", "o"])
    assert _one(df, *parts.values()) == [("50", "5", "0"), ("Z", None, None)]
    assert _one(df, B.code_number(F.col("g"), "USA-")) == [(36,), (None,)]
    assert _one(df, B.ordinal(F.col("v"), ["Z", "50 5 0"]), B.ordinal(F.col("v"), ["Z"])) == [(2, None), (1, 1)]
    assert [B.number_text(x) for x in (5.0, 0.5)] == ["5", "0.5"]


def test_rolling_mean_edges(spark):
    rows = [("a", i, x) for i, x in enumerate([1.0, None, 3.0, 5.0])]
    df = literal_table(spark, rows, "state string, ymd int, x double")
    w = by_area()
    got = _one(df.orderBy("ymd"), rolling_mean("x", 2, w), rolling_mean("x", 2, w, skip_null=False))
    assert got == [(None, None), (1.0, None), (3.0, None), (4.0, 4.0)]


def test_half_even_rounding(spark):
    df = literal_table(spark, [(0.5,), (1.5,), (2.5,)], "x double")
    assert _one(df, F.bround("x", 0)) == [(0.0,), (2.0,), (2.0,)]

"""Data checks on daily and weekly panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riskpanel.functions.series import by_area, rolling_mean
from riskpanel.operators.aggregates import duplicate_keys, panel_completeness, variable_profile
from riskpanel.operators.reshape import stack
from riskpanel.session import literal_table


def reconcile(left: DataFrame, right: DataFrame, axes: dict[str, str], value: str = "value") -> DataFrame:
    """Ratio of the two sources' totals along each axis; each side is summed before they meet."""
    parts = []
    for axis, key in axes.items():
        a = left.groupBy(F.col(key).cast("string").alias("key")).agg(F.sum(value).alias("left_total"))
        b = right.groupBy(F.col(key).cast("string").alias("key")).agg(F.sum(value).alias("right_total"))
        parts.append(a.join(b, "key", "left").select(
            F.lit(axis).alias("axis"), "key", F.try_divide("left_total", "right_total").alias("ratio")))
    return stack(parts)


def lag_consistency(df: DataFrame, led: str, base: str, rows: int, area: str = "state", date: str = "ymd") -> DataFrame:
    """Share of areas whose led value at a date equals the base value ``rows`` rows later, by date."""
    later = F.lead(base, rows).over(by_area(area, date))
    agree = df.select(date, (F.col(led) == later).alias("agree"))
    return agree.groupBy(date).agg(
        F.count("agree").alias("n_compared"), F.avg(F.col("agree").cast("double")).alias("share_equal"))


def rolling_mean_check(df: DataFrame, value: str, k: int, area: str = "state", date: str = "ymd") -> DataFrame:
    """Rolling mean against a plain mean of the same k rows, for every block of k rows of an area."""
    w = by_area(area, date)
    numbered = df.select(
        area, date, F.col(value).alias("x"), rolling_mean(value, k, w).alias("rolled"),
        F.row_number().over(w).alias("r"))
    blocks = numbered.withColumn("block", F.floor((F.col("r") - 1) / k))
    by_block = blocks.groupBy(area, "block").agg(
        F.avg("x").alias("plain"), F.count(F.lit(1)).alias("rows"),
        F.max(F.when((F.col("r") - 1) % k == k - 1, F.col("rolled"))).alias("rolled"))
    full = by_block.where(F.col("rows") == k)
    return full.groupBy(area).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_if(F.abs(F.col("plain") - F.col("rolled")) < 1e-9).alias("n_equal"))


def watched(df: DataFrame, measures: Sequence[str]) -> tuple[DataFrame, Observation]:
    """``df`` whose rows, NULLs, minima and maxima are counted by whatever action runs it first, such as the write of a panel: no scan of their own."""
    seen = Observation()
    counts = [c for m in measures for c in (F.count_if(F.col(m).isNull()).alias(f"n_missing|{m}"), F.min(F.col(m).cast("double")).alias(f"min_value|{m}"),
                                            F.max(F.col(m).cast("double")).alias(f"max_value|{m}"))]
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *counts), seen


def observed_profile(spark: SparkSession, seen: dict, measures: Sequence[str]) -> DataFrame:
    """The profile rows of :func:`dq_report` from the counts of :func:`watched` (a few numbers)."""
    rows = []
    for m in measures:
        missing = seen[f"n_missing|{m}"]
        values = {"n_missing": missing, "share_missing": missing / seen["n_rows"] if seen["n_rows"] else None, "min_value": seen[f"min_value|{m}"],
                  "max_value": seen[f"max_value|{m}"]}
        rows += [(f"profile_{stat}", m, None if v is None else float(v)) for stat, v in values.items()]
    return literal_table(spark, rows, "check string, subject string, value double")


def agreement(panel: DataFrame, leads: dict[str, tuple[str, int]], means: dict[str, int], area: str = "state", date: str = "ymd") -> DataFrame:
    """Check rows: how many led values equal their base so many rows later, and how many rolling means equal the plain mean of their rows."""
    parts = []
    for led, (base, rows) in leads.items():
        by_date = lag_consistency(panel, led, base, rows, area, date)
        parts.append((led, by_date.agg(F.sum("n_compared").alias("lag_n_compared"), F.round(F.sum(F.col("n_compared") * F.col("share_equal"))).alias("lag_n_equal"))))
    for value, k in means.items():
        by_area_rows = rolling_mean_check(panel, value, k, area, date)
        parts.append((value, by_area_rows.agg(F.sum("n_blocks").alias("rolling_n_blocks"), F.sum("n_equal").alias("rolling_n_equal"))))
    return stack([
        p.unpivot([], [F.col(c).cast("double").alias(c) for c in p.columns], "check", "value").select("check", F.lit(name).alias("subject"), "value") for name, p in parts])


def dq_report(
    panel: DataFrame, measures: Sequence[str], area: str = "state", date: str = "ymd", seen: dict | None = None,
    leads: dict[str, tuple[str, int]] | None = None, means: dict[str, int] | None = None,
) -> DataFrame:
    """One table of checks: name, subject, value. With ``seen``, the counts taken while the panel was written (:func:`watched`), the profile needs no
    scan; ``leads`` and ``means`` add the agreement checks."""
    dup = duplicate_keys(panel, [area, date]).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("duplicate_keys").alias("check"), F.lit("panel").alias("subject"), "value")
    complete = panel_completeness(panel, area)
    spans = complete.unpivot([], [F.col(c).cast("double").alias(c) for c in complete.columns], "subject", "value")
    spans = spans.select(F.lit("completeness").alias("check"), "subject", "value")
    if seen is None:
        profile = variable_profile(panel, measures).unpivot(
            ["var"], [F.col(c).cast("double").alias(c) for c in ("n_missing", "share_missing", "min_value", "max_value")],
            "stat", "value")
        profile = profile.select(F.concat(F.lit("profile_"), "stat").alias("check"), F.col("var").alias("subject"), "value")
    else:
        profile = observed_profile(panel.sparkSession, seen, measures)
    gaps = panel.select(area, F.datediff(F.col(date), F.lag(date).over(by_area(area, date))).alias("gap"))
    gaps = gaps.groupBy(F.col("gap").cast("string").alias("subject")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).where("subject IS NOT NULL").select(
        F.lit("days_between_rows").alias("check"), "subject", "value")
    checks = [dup, spans, profile, gaps]
    if leads or means:
        checks.append(agreement(panel, leads or {}, means or {}, area, date))
    return stack(checks)

"""Trailing training windows: which panel rows each evaluation date may learn from.

A window is the half-open date interval (lo_date, hi_date]. Rows and windows meet through an equi-join on a window
key - the week bucket of the evaluation date, or the calendar quarter before it - with the interval as a residual
condition, so no row is ever compared with every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.dates import day_number, quarter_number

# Days before a label is known.
LABEL_LAG = 21
_QUARTER_KEY = 10_000_000


def eval_dates(panel: DataFrame, start: str, end: str, date: str = "ymd") -> DataFrame:
    """The distinct panel dates of the evaluation range."""
    return panel.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(
        F.col(date).alias("end_date")
    ).distinct()


def weekly_windows(dates: DataFrame, weeks: int, lag: int = LABEL_LAG) -> DataFrame:
    """The last ``weeks`` weeks whose labels are known at each date."""
    end = F.col("end_date")
    return dates.select(
        "end_date", F.lit(weeks).alias("weeks"), F.floor(day_number(end) / 7).cast("int").alias("window_key"),
        F.date_sub(end, lag + 7 * weeks).alias("lo_date"), F.date_sub(end, lag).alias("hi_date"),
    )


def quarterly_windows(dates: DataFrame, lag: int = LABEL_LAG) -> DataFrame:
    """The calendar quarter before each date, as far as its labels are known. ``weeks`` is 0."""
    end = F.col("end_date")
    back = F.add_months(end, -3)
    return dates.select(
        "end_date", F.lit(0).alias("weeks"), (quarter_number(back) + _QUARTER_KEY).cast("int").alias("window_key"),
        F.date_sub(F.trunc(back, "quarter"), 1).alias("lo_date"), F.date_sub(end, lag).alias("hi_date"),
    )


def window_keys(date: Column, max_weeks: int, lag: int = LABEL_LAG) -> Column:
    """Keys of all windows a row of this date can lie in: a handful of week buckets and its quarter."""
    d = day_number(date)
    first, last = F.floor((d + lag) / 7).cast("int"), F.floor((d + lag + 7 * max_weeks - 1) / 7).cast("int")
    return F.concat(F.sequence(first, last), F.array((quarter_number(date) + _QUARTER_KEY).cast("int")))


def in_windows(rows: DataFrame, windows: DataFrame, max_weeks: int, on: tuple[str, ...] = (), date: str = "ymd"):
    """Rows matched to the windows they train; ``on`` adds equality columns present on both sides."""
    keyed = rows.withColumn("window_key", F.explode(window_keys(F.col(date), max_weeks)))
    joined = keyed.join(windows, ["window_key", *on])
    return joined.where((F.col(date) > F.col("lo_date")) & (F.col(date) <= F.col("hi_date")))


def window_audit(panel: DataFrame, windows: DataFrame, max_weeks: int) -> DataFrame:
    """Per window: training rows, dates and first/last training date. Rows are counted by date before the join."""
    by_date = panel.groupBy("ymd").agg(F.count(F.lit(1)).alias("n_date"))
    return in_windows(by_date, windows, max_weeks).groupBy("end_date", "weeks").agg(
        F.sum("n_date").alias("n_rows"), F.count(F.lit(1)).alias("n_dates"),
        F.min("ymd").alias("min_train_date"), F.max("ymd").alias("max_train_date"),
    )

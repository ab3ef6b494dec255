"""Places of rows in a global order, found by one sort and small sums per partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.session import materialize


def in_order(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``df`` dealt out by ranges of ``keys`` and sorted within each range. A last key tells rows with equal keys apart, so that many of
    them do not meet in one task."""
    last = "_last" + "_" * max(map(len, df.columns))
    keyed = df.withColumn(last, F.monotonically_increasing_id())
    order = [*keys, F.col(last).asc()]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop(last)


def ranked(df: DataFrame, group: str, keys: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``idx``, the place (from 0) of a row within its ``group`` (not NULL) in the order of ``keys``, and ``n``, the size of the
    group. No task holds a group: rows are sorted by ranges, and only a count per group and range is summed. Runs jobs when called."""
    row = F.monotonically_increasing_id()  # partition number << 33 | place in the partition
    rows = materialize(in_order(df, [F.col(group).asc(), *keys]).withColumn("row", row), name).withColumn("part", F.shiftright("row", 33))
    parts = rows.groupBy(group, "part").agg(F.min("row").alias("first"), F.count("*").alias("here"))
    over = Window.partitionBy(group)
    parts = parts.withColumn("before", F.sum("here").over(over.orderBy("part")) - F.col("here")).withColumn("n", F.sum("here").over(over)).drop("here")
    return rows.join(parts, [group, "part"]).withColumn("idx", F.col("row") - F.col("first") + F.col("before")).drop("row", "part", "first", "before")

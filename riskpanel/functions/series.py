"""Window columns over one area's time series.

A window partition here is one area's series. (area, date) is unique, so a partition is bounded by the number
of dates in the study, whatever the number of raw rows behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_area(area: str = "state", date: str = "ymd") -> WindowSpec:
    return Window.partitionBy(area).orderBy(date)


def ahead(c: Column | str, rows: int, over: WindowSpec) -> Column:
    return F.lead(c, rows).over(over)


def behind(c: Column | str, rows: int, over: WindowSpec) -> Column:
    return F.lag(c, rows).over(over)


def change(c: str, over: WindowSpec, rows: int = 1) -> Column:
    return F.col(c) - F.lag(c, rows).over(over)


def rolling_mean(c: Column | str, k: int, over: WindowSpec, skip_null: bool = True) -> Column:
    """Mean of the last ``k`` rows, NULL before the k-th row; with ``skip_null=False`` also NULL on any gap."""
    col = F.col(c) if isinstance(c, str) else c
    frame = over.rowsBetween(-(k - 1), 0)
    full = F.count(F.lit(1)).over(frame) == k
    if not skip_null:
        full = full & (F.count(col).over(frame) == k)
    return F.when(full, F.avg(col).over(frame))

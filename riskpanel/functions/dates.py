"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epi_week(d: Column) -> Column:
    """Sunday-start surveillance week: the week belongs to the year of its Wednesday."""
    wednesday = F.date_add(d, F.lit(4) - F.dayofweek(d))
    return F.ceil(F.dayofyear(wednesday) / F.lit(7)).cast("int")


def year_week(d: Column) -> Column:
    """Calendar year and surveillance week; around New Year the two may name different years."""
    return F.concat_ws("-", F.year(d), epi_week(d))


def quarter_label(d: Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, F.year(d), F.quarter(d))


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def weekday_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def is_wednesday(d: Column) -> Column:
    return F.dayofweek(d) == 4


def week_start(d: Column) -> Column:
    """Monday of the week."""
    return F.trunc(d, "week")


def day_number(d: Column) -> Column:
    return F.unix_date(d)


def quarter_number(d: Column) -> Column:
    """Running number of the calendar quarter."""
    return F.year(d) * 4 + F.quarter(d) - 1

"""NULL-aware conditional columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacement of a suppressed (negative) count, by kind of measure.
SUPPRESSED_VALUES = {"adult_admissions": 2.0, "paediatric_admissions": 0.5, "icu_patients": 0.5, "beds": 0.0}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else(test: Column, yes: Column, no: Column) -> Column:
    """Two-way choice in which an unknown test gives NULL."""
    return F.when(test, yes).when(~test, no)


def impute_suppressed(c: Column | str, value: float) -> Column:
    """Negative sentinel -> ``value``; NULL stays NULL."""
    return F.when(_col(c) < 0, F.lit(float(value))).otherwise(_col(c))


def impute_columns(values: Mapping[str, float]) -> dict[str, Column]:
    """Columns for ``withColumns``: each named column with its suppressed counts replaced."""
    return {name: impute_suppressed(name, value) for name, value in values.items()}


def sentinel_to_null(c: Column | str) -> Column:
    return F.when(_col(c) >= 0, _col(c))


def null_unless(c: Column | str, other: Column | str) -> Column:
    """``c`` where ``other`` is known, so that numerator and denominator go missing together."""
    return F.when(_col(other).isNotNull(), _col(c))


def ratio_or_one(num: Column | str, den: Column | str) -> Column:
    """num/den, with 1 for a missing part or a zero denominator."""
    return F.coalesce(F.try_divide(_col(num), _col(den)), F.lit(1.0))


def cap_at_one(c: Column) -> Column:
    return F.least(c, F.lit(1.0))


def zero_if_missing(c: Column | str) -> Column:
    """NULL or NaN -> 0."""
    return F.coalesce(F.nanvl(_col(c), F.lit(None).cast("double")), F.lit(0.0))


def zero_if_infinite(c: Column | str) -> Column:
    return F.when(_col(c) == float("inf"), F.lit(0.0)).otherwise(_col(c))


def patched(patch: Column | str, original: Column | str) -> Column:
    """The replacement series wins wherever it has a value."""
    return F.coalesce(_col(patch), _col(original))


def is_in(c: Column | str, values: Sequence) -> Column:
    """Set membership that is FALSE, not NULL, for a NULL value."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def not_in(c: Column | str, values: Sequence) -> Column:
    return ~is_in(c, values)


def update_where(c: Column | str, cond: Column, value: Column) -> Column:
    """``c`` overwritten where ``cond`` is certainly true."""
    return F.when(F.coalesce(cond, F.lit(False)), value).otherwise(_col(c))


def clip_below(c: Column | str, floor: float = 0.0) -> Column:
    return F.when(_col(c) < floor, F.lit(floor)).otherwise(_col(c))


def per_100k(c: Column | str, population: Column | str, scale: float = 100000.0) -> Column:
    return F.try_divide(_col(c), _col(population).cast("double")) * F.lit(float(scale))


def community_level_parts(
    cases: Column,
    admissions: Column,
    bed_share: Column,
    case_cut: float = 200 / 7,
    low: tuple[float, float] = (10 / 7, 0.10),
    high: tuple[float, float] = (20 / 7, 0.15),
) -> tuple[Column, Column]:
    """The two branches of the published "high" level; both case comparisons are strict."""
    above = (cases > case_cut) & ((admissions > low[0]) | (bed_share > low[1]))
    below = (cases < case_cut) & ((admissions > high[0]) | (bed_share > high[1]))
    return above, below

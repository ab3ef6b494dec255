"""Group aggregates with the engine's NULL rules. All combine map-side, so a hot key shrinks before it moves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_present(c: Column | str) -> Column:
    """Sum of the known values; a group without any sums to 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def sum_complete(c: str) -> Column:
    """Sum that is NULL as soon as one value is missing."""
    return F.when(F.count(F.col(c)) == F.count(F.lit(1)), F.sum(c))


def count_missing(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.count_if(col.isNull())


def share_missing(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.avg(col.isNull().cast("double"))


def share_true(cond: Column) -> Column:
    """Share of true among the known values."""
    return F.avg(cond.cast("double"))


def weighted_mean(c: Column | str, weight: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.try_divide(F.sum(col * w), F.sum(F.when(col.isNotNull(), w)))


def first_by(c: str, order: Sequence[str]) -> Column:
    """First value of a group under an explicit order."""
    return F.min_by(c, F.struct(*order))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def variable_profile(df: DataFrame, variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per variable: rows, missing rows and share, min, max, mean - after one unpivot that keeps NULLs."""
    long = df.unpivot(list(by), [F.col(v).cast("double").alias(v) for v in variables], "var", "value")
    return long.groupBy(*by, "var").agg(
        F.count(F.lit(1)).alias("n"),
        count_missing("value").alias("n_missing"),
        share_missing("value").alias("share_missing"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"),
    )


def panel_completeness(df: DataFrame, area: str = "state") -> DataFrame:
    """Rows per area, then the smallest and largest count over areas."""
    return df.groupBy(area).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("n_areas"),
        F.min("n").alias("min_rows"),
        F.max("n").alias("max_rows"),
    )


def area_totals(df: DataFrame, date: str, population: str) -> DataFrame:
    """Per date: total population (NULL if one is missing) and number of areas."""
    return df.groupBy(date).agg(
        sum_complete(population).alias("population_total"), F.count(F.lit(1)).alias("n_areas")
    )


def date_weights(
    df: DataFrame, date: str = "ymd", population: str = "POPESTIMATE2019", source: DataFrame | None = None
) -> DataFrame:
    """Population share and equal share of each area within its date.

    The totals are one row per date from a partial aggregate, joined back: no date is gathered into one task. A
    ``source`` with the same areas and dates lets the totals come from a stored table instead of a second run of
    everything behind ``df``.
    """
    totals = area_totals(df if source is None else source, date, population).withColumnRenamed(date, "k_date")
    return (
        df.join(totals, F.col(date) == F.col("k_date"), "left")
        .withColumns({
            "weight": F.try_divide(F.col(population).cast("double"), F.col("population_total").cast("double")),
            "weight_alt": 1.0 / F.col("n_areas"),
        })
        .drop("k_date", "population_total", "n_areas")
    )


def group_zscore(df: DataFrame, c: str, by: Sequence[str], name: str) -> DataFrame:
    """(x - mean) / sample sd within a group, through an aggregate joined back."""
    stats = df.groupBy(*by).agg(F.avg(c).alias("g_mean"), F.stddev_samp(c).alias("g_sd"))
    stats = stats.select(*[F.col(b).alias(f"k_{b}") for b in by], "g_mean", "g_sd")
    on = [F.col(b).eqNullSafe(F.col(f"k_{b}")) for b in by]
    scored = df.join(stats, on).withColumn(name, F.try_divide(F.col(c) - F.col("g_mean"), F.col("g_sd")))
    return scored.drop("g_mean", "g_sd", *[f"k_{b}" for b in by])

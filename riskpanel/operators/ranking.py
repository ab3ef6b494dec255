"""Ranks and exact quantiles that never sort a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskpanel.session import materialize

# Number of value ranges a distribution is cut into. Each range is sorted on its own.
RANGES = 64
CUT_POINTS = [i / RANGES for i in range(1, RANGES)]


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values (a missing one too) with their row counts, stored.

    Ties collapse here, before anything is sorted, so one value repeated in a third of all rows costs one row. The
    steps below read this table several times; stored once, it is computed once and has a known size.
    """
    return materialize(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_ties")), "value_counts")


def _ranged_counts(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds the value range each value lies in and the number of rows before that range.

    The cut points of the ranges come from a mergeable sketch; they only balance the work and do not affect the
    result.
    """
    values = counts.where(F.col(value).isNotNull())
    cuts = values.groupBy(*by).agg(F.percentile_approx(value, CUT_POINTS, F.lit(1000)).alias("cuts"))
    if by:
        joined = values.join(cuts.select(*[F.col(b).alias(f"k_{b}") for b in by], "cuts"),
                             on=[F.col(b).eqNullSafe(F.col(f"k_{b}")) for b in by])
        joined = joined.drop(*[f"k_{b}" for b in by])
    else:
        joined = values.withColumn("cuts", cuts.select("cuts").scalar())
    ranged = joined.select(
        *by, value, "n_ties",
        F.size(F.filter("cuts", lambda c: c < F.col(value))).alias("value_range"),
    )
    sizes = ranged.groupBy(*by, "value_range").agg(F.sum("n_ties").alias("range_n"))
    # At most RANGES rows per group from here on.
    running = Window.partitionBy(*by).orderBy("value_range")
    starts = sizes.select(
        *[F.col(b).alias(f"k_{b}") for b in by],
        F.col("value_range").alias("k_range"),
        (F.sum("range_n").over(running) - F.col("range_n")).alias("n_before_range"),
        F.sum("range_n").over(Window.partitionBy(*by)).alias("n_group"),
    )
    on = [F.col("value_range") == F.col("k_range")] + [F.col(b).eqNullSafe(F.col(f"k_{b}")) for b in by]
    return ranged.join(starts, on=on).drop("k_range", *[f"k_{b}" for b in by])


def value_positions(counts: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct value of ``value_counts``: ``n_below`` (rows of the group with a smaller value) and ``n_group``."""
    by = list(by)
    w = Window.partitionBy(*by, "value_range").orderBy(value)
    return _ranged_counts(counts, value, by).select(
        *by, value, "n_ties", "n_group",
        (F.col("n_before_range") + F.sum("n_ties").over(w) - F.col("n_ties")).alias("n_below"),
    )


def rank_table(df: DataFrame, value: str, name: str, descending: bool = True) -> DataFrame:
    """Each distinct value with its rank over all rows of ``df``, ties sharing their mean rank."""
    pos = value_positions(value_counts(df, value), value)
    n_ahead = F.col("n_group") - F.col("n_below") - F.col("n_ties") if descending else F.col("n_below")
    return pos.select(value, (n_ahead + (F.col("n_ties") + 1) / 2).alias(name))


def rank_average_ties(df: DataFrame, value: str, name: str, descending: bool = True) -> DataFrame:
    """Rank over the whole table with ties sharing their mean rank; NULL values keep a NULL rank."""
    ranks = rank_table(df, value, name, descending).withColumnRenamed(value, "k_value")
    return df.join(ranks, F.col(value) == F.col("k_value"), "left").drop("k_value")


def ordered_positions(df: DataFrame, value: str, name: str = "r") -> DataFrame:
    """1-based position of each distinct value in ascending order, with the number of distinct values ``n``."""
    pos = value_positions(value_counts(df.select(value).distinct(), value), value)
    return pos.select(value, (F.col("n_below") + 1).alias(name), F.col("n_group").alias("n"))


def exact_quantiles(
    df: DataFrame, value: str, by: Sequence[str], probs: dict[str, float], count_name: str = "n"
) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics, and the group's row count.

    NULL values count as rows and make every quantile of their group NULL, as a missing value does in an
    order statistic.
    """
    by = list(by)
    counts = value_counts(df, value, by)
    pos = value_positions(counts, value, by)
    spots = F.array(*[F.struct(F.lit(name).alias("q"), F.lit(float(p)).alias("p")) for name, p in probs.items()])
    at = F.lit(1.0) * F.col("s.p") * (F.col("n_group") - 1)
    lo, hi = F.floor(at), F.ceil(at)
    last = F.col("n_below") + F.col("n_ties") - 1
    # A distinct value covers the 0-based positions n_below..last, so each quantile matches one or two values.
    hits = pos.withColumn("s", F.explode(spots)).where((F.col("n_below") <= hi) & (last >= lo))
    weight = F.when(lo == hi, F.lit(1.0)).otherwise(
        F.when((F.col("n_below") <= lo) & (last >= lo), hi - at).otherwise(F.lit(0.0))
        + F.when((F.col("n_below") <= hi) & (last >= hi), at - lo).otherwise(F.lit(0.0))
    )
    picks = hits.groupBy(*by).agg(
        *[F.sum(F.when(F.col("s.q") == name, F.col(value) * weight)).alias(name) for name in probs]
    )
    sizes = counts.groupBy(*by).agg(
        F.sum("n_ties").alias(count_name),
        F.sum(F.when(F.col(value).isNotNull(), F.col("n_ties")).otherwise(0)).alias("n_known"),
    )
    keyed = picks.select(*[F.col(b).alias(f"k_{b}") for b in by], *probs)
    joined = sizes.join(keyed, [F.col(b).eqNullSafe(F.col(f"k_{b}")) for b in by], "left")
    complete = F.col("n_known") == F.col(count_name)
    return joined.select(*by, count_name, *[F.when(complete, F.col(q)).alias(q) for q in probs])

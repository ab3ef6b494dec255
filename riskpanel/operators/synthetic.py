"""Table operations of the synthetic-label study (the random draws themselves are not part of the engine)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.series import by_area

CUTOFFS = [f"cutoff{i}" for i in range(1, 7)]


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cutoff_schedules(positions: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Six cut-off series over the ordered dates. The numbers are fixed values of the study."""
    t = F.col(r)
    return positions.withColumns({
        "cutoff1": F.lit(5.0),
        "cutoff2": F.lit(10.0),
        "cutoff3": 5 + F.try_divide(10.0 * (t - 1), F.col(n) - 1),
        "cutoff4": 5 + 10 * logistic(0.3 * (t - 40)),
        "cutoff5": (20 - 0.01 * F.pow(t - 25, F.lit(2.0)) + 10) / 2,
        "cutoff6": 5 + 10 * logistic(0.3 * (t - 25)) - 5 * logistic(0.4 * (t - 45)),
    })


def synthetic_outcomes(panel: DataFrame, schedules: DataFrame, slope: float = 3.0, weeks: int = 3) -> DataFrame:
    """The panel with one column per cut-off series, 1 where the synthetic outcome has at least probability one half, and each
    series' value ``weeks`` rows earlier: columns of the wide panel, so the only shuffle is the window's."""
    dates = schedules.select(F.col("ymd").alias("k_ymd"), *[F.col(c).alias(f"k_{c}") for c in CUTOFFS])
    joined = panel.join(dates, F.col("ymd") == F.col("k_ymd"), "left")
    outcome = {c: (logistic(slope * (F.col("admits_weekly") - F.col(f"k_{c}"))) >= 0.5).cast("double") for c in CUTOFFS}
    w = by_area()
    return joined.withColumns(outcome).withColumns({f"lag_{c}": F.lag(c, weeks).over(w) for c in CUTOFFS}).drop("k_ymd", *[f"k_{c}" for c in CUTOFFS])


def replicate_mean(results: DataFrame, replicate: str, value: str = "metric_value") -> DataFrame:
    """Mean over replicates of every other column's group."""
    keys = [c for c in results.columns if c not in (replicate, value)]
    return results.groupBy(*keys).agg(F.avg(value).alias(value))

"""How often a flag changes from week to week."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskpanel.operators.joins import full_join


def _changes(c: str, w) -> tuple[Column, Column]:
    now, before, after = F.col(c), F.lag(c).over(w), F.lead(c).over(w)
    return now != before, (now == after) & (now != before)


def switch_totals(
    df: DataFrame, flags: Sequence[str], by: Sequence[str] = (), area: str = "state", date: str = "ymd"
) -> DataFrame:
    """Per flag: ``chg`` changes and ``chg2`` changes that last at least one more row, over all areas.

    All flags share one sort by area; the totals are turned into rows after the aggregate.
    """
    w = Window.partitionBy(area, *by).orderBy(date)
    marked = df.select(*by, *[
        c.alias(f"{name}_{i}")
        for i, f in enumerate(flags) for name, c in zip(("chg", "chg2"), _changes(f, w), strict=True)
    ])
    sums = marked.groupBy(*by).agg(*[
        F.count_if(f"{name}_{i}").alias(f"{name}_{i}") for i in range(len(flags)) for name in ("chg", "chg2")
    ])
    rows = F.array(*[
        F.struct(F.lit(f).alias("flag"), F.lit(name).alias("var"), F.col(f"{name}_{i}").alias("tot"))
        for i, f in enumerate(flags) for name in ("chg", "chg2")
    ])
    return sums.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def switch_summary(predicted: DataFrame, panel: DataFrame, outcomes: Sequence[str], baseline: str = "cdc_flag"):
    """Changes of the predicted class, of the true outcome and of the published rule, side by side.

    ``predicted`` has one row per area, date and ``outcome_label`` with its class ``value``.
    """
    mine = switch_totals(predicted, ["value"], ["outcome_label"]).select(
        "outcome_label", "var", F.col("tot").alias("tot_predicted"))
    true = switch_totals(panel, [*outcomes, baseline]).withColumnRenamed("tot", "tot_true")
    both = full_join(mine, true, {"outcome_label": "flag", "var": "var"})
    # The baseline's two totals are copied to every row through a two-row lookup.
    base = true.where(F.col("flag") == baseline).select(F.col("var").alias("k_var"), F.col("tot_true").alias("CL"))
    return both.where(F.col("outcome_label") != baseline).join(base, F.col("var") == F.col("k_var"), "left").drop("k_var")

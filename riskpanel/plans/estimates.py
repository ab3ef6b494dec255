"""Metric tables: static rules, adaptive models, preference sets and the cost-ratio sweep."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.labels import PREFERENCES
from riskpanel.operators import logistic as L
from riskpanel.operators import scoring as S
from riskpanel.operators.rules import DEFAULT_OUTCOMES, Grid
from riskpanel.operators.training import eval_dates, quarterly_windows, weekly_windows, window_audit

# Cost ratios of the sweep.
ROC_CUTS = (1 / 100, 1 / 20, 1 / 15, 1 / 10, 1 / 7, 1 / 5, 1 / 3, 1 / 2, 1, 2, 3, 5, 7, 10, 15, 20, 100)
# Same labels without cost differences, for the always-on prevalence rule.
NO_PREFERENCES = dict.fromkeys(PREFERENCES, 1.0)


@dataclass(frozen=True)
class Study:
    """Evaluation range and the last day of the training side."""

    start: str
    end: str
    split: str


def cost_sums(scored: DataFrame, by: Sequence[str], mults: Sequence[float], study: Study, weight: str = "weight"):
    """Confusion sums per cost ratio without repeating the scored rows for every ratio.

    A prediction becomes the number of probability cut-offs it reaches; rows are summed by that number, and only
    the summed cells are compared with each ratio.
    """
    mults = sorted(set(map(float, mults)), reverse=True)
    pred = F.col("pred")
    reached = sum((F.when(L.predicted_class(pred, m), 1).when(pred.isNotNull(), 0) for m in mults), F.lit(0))
    keys = ["quarter_label", "split_label", *by]
    rows = S.with_period_parts(scored, study.start, study.end, study.split)
    cells = rows.select(*keys, weight, reached.alias("reached"), F.col("outcome_value").cast("boolean").alias("y"))
    cells = cells.groupBy(*keys, "reached", "y").agg(
        F.count(F.lit(1)).alias("n"), F.count(weight).alias("n_weight"),
        F.coalesce(F.sum(weight), F.lit(0.0)).alias("w_all"),
    )
    cuts = F.array(*[F.struct(F.lit(m).alias("mult"), F.lit(i + 1).alias("need")) for i, m in enumerate(mults)])
    v = F.col("reached") >= F.col("cut.need")
    fanned = cells.withColumn("cut", F.explode(cuts)).select(
        *keys, "cut.mult", "n", "n_weight", "w_all", *S.sum_columns(v, F.col("y"), F.col("w_all"))
    )
    return S.roll_up_periods(fanned, [*by, "mult"])


def adaptive_metrics(
    scored: DataFrame, study: Study, preferences: dict[str, float] = PREFERENCES, weeks: int = 4,
    weeks_non_neutral: int = 4, weight: str = "weight",
) -> DataFrame:
    """Metrics of the refitted models per preference set. The fits do not depend on the preference, so all sets
    share one scored table. Only the neutral set uses ``weeks``; the others keep their own window."""
    sums = cost_sums(scored, ["spec", "weeks", "outcome_label"], list(preferences.values()), study, weight)
    sets = F.array(*[
        F.struct(F.lit(lab).alias("lab"), F.lit(float(m)).alias("m"),
                 F.lit(weeks if lab == "Neutral" else weeks_non_neutral).alias("w"))
        for lab, m in preferences.items()
    ])
    chosen = sums.withColumn("p", F.explode(sets)).where(
        (F.col("mult") == F.col("p.m")) & ((F.col("weeks") == 0) | (F.col("weeks") == F.col("p.w")))
    )
    named = chosen.withColumns({"lab": F.col("p.lab"), "var": F.col("spec"), "rule_kind": F.lit("adaptive")})
    return S.rates(named.drop("p", "spec", "weeks"), F.col("mult"))


def fit_and_score(
    panel: DataFrame, study: Study, specs: Sequence[L.Spec] = L.DEFAULT_SPECS,
    outcomes: Sequence[str] = DEFAULT_OUTCOMES, weeks: Sequence[int] = (4,), weight: str = "weight",
) -> DataFrame:
    rows = L.model_rows(panel, outcomes)
    fits = L.fit_logistic(rows, eval_dates(panel, study.start, study.end), specs, outcomes, weeks, weight)
    return L.score(rows, fits)


def with_audit(scored: DataFrame, panel: DataFrame, study: Study, weeks: Sequence[int] = (4,)) -> DataFrame:
    """Predictions with the first and last training date of their fit's window, from the dates of the panel (a row per window)."""
    dates = eval_dates(panel, study.start, study.end)
    windows = quarterly_windows(dates)
    for w in weeks:
        windows = windows.unionByName(weekly_windows(dates, w))
    audit = window_audit(panel, windows, max(weeks)).select(
        F.col("end_date").alias("a_date"), F.col("weeks").alias("a_weeks"), "min_train_date", "max_train_date")
    own = (F.col("test_date") == F.col("a_date")) & (F.col("weeks") == F.col("a_weeks"))
    return scored.join(audit, own, "left").drop("a_date", "a_weeks")


def base_estimates(
    panel: DataFrame, grid: Grid, study: Study, scored: DataFrame | None = None,
    outcomes: Sequence[str] = DEFAULT_OUTCOMES, preferences: dict[str, float] = PREFERENCES, weeks: int = 4,
    weeks_non_neutral: int = 4, weight: str = "weight",
) -> DataFrame:
    """The long metric table of one run: grid rules, baselines and, with ``scored``, the refitted models."""
    sums = S.rule_sums(panel, [grid], outcomes, study.start, study.end, study.split, weight=weight)
    table = S.with_preferences(sums, preferences)
    if scored is not None:
        adaptive = adaptive_metrics(
            scored.where(F.col("outcome_label").isin(*outcomes)), study, preferences, weeks, weeks_non_neutral, weight
        )
        table = table.unionByName(adaptive.withColumn("type", F.lit(grid.kind)))
    return S.to_metric_rows(table)


def roc_estimates(
    panel: DataFrame, grid: Grid, study: Study, scored: DataFrame, cuts: Sequence[float] = ROC_CUTS,
    outcomes: Sequence[str] = ("zeke_time_3", "two_zeke_time_3"), weight: str = "weight",
) -> DataFrame:
    """The metric table with one set of rows per cost ratio ``mult``."""
    sums = S.rule_sums(panel, [grid], outcomes, study.start, study.end, study.split, weight=weight)
    ratios = F.array(*[F.lit(float(c)) for c in cuts])
    static = S.rates(sums.withColumn("mult", F.explode(ratios)), F.col("mult"))
    own = scored.where(F.col("outcome_label").isin(*outcomes))
    adaptive = cost_sums(own, ["spec", "outcome_label"], cuts, study, weight).withColumns(
        {"type": F.lit(grid.kind), "rule_kind": F.lit("adaptive"), "var": F.col("spec")}
    ).drop("spec")
    return S.to_metric_rows(static.unionByName(S.rates(adaptive, F.col("mult"))))

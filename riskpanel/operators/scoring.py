"""Population-weighted confusion matrices with asymmetric costs.

Everything is derived from eight weighted sums over (rule value x outcome), each side true, false or unknown.
The sums are additive, so they are taken once at the finest grain and then rolled up to rules, periods and
preference sets on a table whose size depends on the parameters and not on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.dates import quarter_label
from riskpanel.functions.labels import METRIC_NAMES, OUTCOME_NAMES, PREFERENCES, RULE_NAMES, recode
from riskpanel.operators.rules import DEFAULT_OUTCOMES, Grid, cell_rule, reached_levels, with_outcomes

# s<value><outcome>: 1 true, 0 false, n unknown.
SUMS = ("s11", "s10", "s1n", "s01", "s00", "s0n")
COUNTS = ("n", "n_weight", "w_all")


def _state(c: Column, code: str) -> Column:
    if code == "n":
        return c.isNull()
    return c if code == "1" else ~c


def sum_columns(value: Column, outcome: Column, weight: Column) -> list[Column]:
    """The weight of a row (or of a summed cell), placed in the sum its state belongs to."""
    return [
        F.when(_state(value, s[1]) & _state(outcome, s[2]), weight).otherwise(0.0).alias(s) for s in SUMS
    ]


def confusion_sums(
    df: DataFrame, by: Sequence[str], weight: str = "weight", outcome: str = "outcome_value", value: str = "value"
) -> DataFrame:
    """The additive sums per group. Partial aggregation runs before the shuffle."""
    v, y, w = F.col(value).cast("boolean"), F.col(outcome).cast("boolean"), F.col(weight)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(w).alias("n_weight"),
        F.coalesce(F.sum(w), F.lit(0.0)).alias("w_all"),
        *[
            F.coalesce(F.sum(F.when(_state(v, s[1]) & _state(y, s[2]), w)), F.lit(0.0)).alias(s)
            for s in SUMS
        ],
    )


def add_sums(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rolls sums up to coarser groups."""
    return sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS + SUMS])


def rates(sums: DataFrame, mult: Column | float = 1.0) -> DataFrame:
    """Metrics from the sums; ``mult`` is the cost of a false negative in false positives.

    A rate without cases is NULL. ``pos`` and ``neg`` count rows with an unknown outcome and ``fn``/``fp`` do not.
    """
    m = F.lit(float(mult)) if isinstance(mult, (int, float)) else mult
    a = (m - 1) / (m + 1)
    s = {name: F.col(name) for name in SUMS}
    fn, fp = (1 + a) * s["s01"], (1 - a) * s["s10"]
    pos, neg = s["s11"] + s["s10"] + s["s1n"], s["s01"] + s["s00"] + s["s0n"]
    known = s["s11"] + s["s10"] + s["s01"] + s["s00"]
    measures = {
        "sens": F.try_divide(s["s11"], s["s11"] + s["s01"]),
        "spec": F.try_divide(s["s00"], s["s00"] + s["s10"]),
        "ppv": F.try_divide(s["s11"], s["s11"] + s["s10"]),
        "npv": F.try_divide(s["s00"], s["s00"] + s["s01"]),
        "percright": F.try_divide(s["s11"] + s["s00"], known),
        "n2": F.when(F.col("n_weight") == F.col("n"), F.col("w_all")),
        "fn": fn, "fp": fp, "tn": s["s00"], "tp": s["s11"], "pos": pos, "neg": neg,
        "w_acc": 1 - F.try_divide(fn + fp, pos + neg),
    }
    keys = [c for c in sums.columns if c not in SUMS and c not in COUNTS]
    return sums.select(*keys, "n", *[c.alias(name) for name, c in measures.items()])


def confusion_metrics(
    df: DataFrame, by: Sequence[str], mult: Column | float = 1.0, weight: str = "weight",
    outcome: str = "outcome_value", value: str = "value",
) -> DataFrame:
    return rates(confusion_sums(df, by, weight, outcome, value), mult)


def with_period_parts(df: DataFrame, start: str, end: str, split: str, date: str = "ymd") -> DataFrame:
    """Keeps the evaluation range and adds the finest period: quarter and side of the split."""
    d = F.col(date)
    return df.where((d >= F.lit(start).cast("date")) & (d <= F.lit(end).cast("date"))).withColumns({
        "quarter_label": quarter_label(d),
        "split_label": F.when(d > F.lit(split).cast("date"), "Test").otherwise("Training"),
    })


def roll_up_periods(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overall, Training/Test and quarter rows from sums at the finest period."""
    periods = F.array(F.lit("Overall"), F.col("split_label"), F.col("quarter_label"))
    return add_sums(sums.withColumn("quarter", F.explode(periods)), ["quarter", *by])


def period_metrics(
    df: DataFrame, by: Sequence[str], start: str, end: str, split: str, mult: Column | float = 1.0
) -> DataFrame:
    """Metrics by period from a frame with ``value``, ``outcome_value`` and ``weight``: one pass over the rows."""
    fine = confusion_sums(with_period_parts(df, start, end, split), ["quarter_label", "split_label", *by])
    return rates(roll_up_periods(fine, by), mult)


def rule_sums(
    panel: DataFrame, grids: Sequence[Grid], outcomes: Sequence[str], start: str, end: str, split: str,
    fixed_rules: bool = True, weight: str = "weight", by: Sequence[str] = (),
) -> DataFrame:
    """Sums per period x outcome x rule without fanning the panel out over the grid.

    The panel is summed by the levels each indicator reaches, and only these cells meet the rules.
    """
    reached, levels = reached_levels(grids)
    keys = ["quarter_label", "split_label", "outcome_label", *by]
    state = [*reached, "cdc_flag", "z_rule", "y"]
    rows = with_outcomes(with_period_parts(panel, start, end, split), outcomes).withColumns(
        reached | {"y": F.col("outcome_value").cast("boolean")}
    )
    cells = rows.groupBy(*keys, *state).agg(
        F.count(F.lit(1)).alias("n"), F.count(weight).alias("n_weight"),
        F.coalesce(F.sum(weight), F.lit(0.0)).alias("w_all"),
    )

    rules = []
    for grid in grids:
        for cell in grid.cells():
            rules.append(F.struct(F.lit(grid.kind).alias("type"), F.lit("static").alias("rule_kind"),
                                  F.lit(grid.label(cell)).alias("var"), cell_rule(cell, levels).alias("v")))
    if fixed_rules:
        for var, met in (("cdc_flag", F.col("cdc_flag")), ("current_zeke", F.col("z_rule") > 0)):
            rules.append(F.struct(F.lit(grids[0].kind).alias("type"), F.lit("baseline").alias("rule_kind"),
                                  F.lit(var).alias("var"), met.alias("v")))
    met_cells = cells.withColumn("r", F.explode(F.array(*rules))).select(
        *keys, "r.type", "r.rule_kind", "r.var", "n", "n_weight", "w_all",
        *sum_columns(F.col("r.v"), F.col("y"), F.col("w_all")),
    )
    return roll_up_periods(met_cells, ["type", "rule_kind", "var", "outcome_label", *by])


def with_preferences(sums: DataFrame, preferences: dict[str, float] = PREFERENCES) -> DataFrame:
    """Metrics for each preference set: costs enter after the sums, so a preference costs no data pass."""
    sets = F.array(*[F.struct(F.lit(k).alias("lab"), F.lit(float(m)).alias("mult")) for k, m in preferences.items()])
    fanned = sums.withColumn("p", F.explode(sets)).withColumns({"lab": F.col("p.lab"), "mult": F.col("p.mult")})
    return rates(fanned.drop("p"), F.col("mult"))


def to_metric_rows(metrics: DataFrame) -> DataFrame:
    """Wide metrics -> one row per metric with display names for metric, rule and outcome."""
    ids = [c for c in metrics.columns if c not in METRIC_NAMES]
    return metrics.unpivot(ids, list(METRIC_NAMES), "metric", "metric_value").withColumns({
        "metric": recode(F.col("metric"), METRIC_NAMES),
        "var": recode(F.col("var"), RULE_NAMES),
        "lab2": recode(F.col("outcome_label"), OUTCOME_NAMES),
    })


def static_metrics(
    panel: DataFrame, grids: Sequence[Grid], start: str, end: str, split: str,
    outcomes: Sequence[str] = DEFAULT_OUTCOMES, preferences: dict[str, float] = PREFERENCES,
    fixed_rules: bool = True, weight: str = "weight",
) -> DataFrame:
    """The metric table of static rules, the published rule and the current outcome, in long form."""
    sums = rule_sums(panel, grids, outcomes, start, end, split, fixed_rules, weight)
    return to_metric_rows(with_preferences(sums, preferences))

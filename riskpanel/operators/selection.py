"""Choosing and comparing rules. These work on metric tables, whose size is set by the rules, periods and preference
sets of a study and not by its data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskpanel.functions.conditions import clip_below
from riskpanel.functions.labels import split_label
from riskpanel.operators.reshape import to_wide

# Two scores closer than this are the same score: sums of the same rows may differ in their last digits.
SCORE_DIGITS = 9
SIDES = ("Overall", "Training", "Test")


def _max_complete(c: str, w) -> Column:
    return F.when(F.count(F.col(c)).over(w) == F.count(F.lit(1)).over(w), F.max(c).over(w))


def metric_wide(rows: DataFrame, metric: str, quarters: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """One metric, one row per rule, one column per period."""
    kept = rows.where(F.col("metric") == metric).withColumn("metric_value", F.round("metric_value", SCORE_DIGITS))
    return to_wide(kept, ids, "quarter", "metric_value", [*SIDES, *quarters])


def mark_best(wide: DataFrame, by: Sequence[str] = ("lab", "lab2", "type")) -> DataFrame:
    """Flags the static rules with the best training score of their group; ties are all kept, and a group with an
    unknown training score has no best rule."""
    w = Window.partitionBy(*by, "rule_kind")
    return wide.withColumn(
        "best", F.coalesce((F.col("rule_kind") == "static") & (F.col("Training") == _max_complete("Training", w)),
                           F.lit(False)))


def best_static(rows: DataFrame, quarters: Sequence[str], metric: str = "Weighted accuracy") -> DataFrame:
    wide = metric_wide(rows, metric, quarters, ["lab", "lab2", "type", "rule_kind", "var"])
    return mark_best(wide).where("best").select("lab", "lab2", "type", "var")


def comparison_table(
    rows: DataFrame, quarters: Sequence[str], others: Sequence[str] | None, metric: str = "Weighted accuracy",
    group: Sequence[str] = (),
) -> DataFrame:
    """Best static rule of each type beside the named other rules, as whole percentages by period.

    ``others=None`` keeps the refitted models only. ``group`` adds id columns such as a scenario.
    """
    ids = ["lab", "lab2", *group]
    wide = mark_best(
        metric_wide(rows, metric, quarters, [*ids, "type", "rule_kind", "var"]), [*ids, "type"]
    )
    if others is None:
        kept = wide.where(F.col("rule_kind") == "adaptive")
    else:
        kept = wide.where(F.col("best") | ((F.col("rule_kind") != "static") & F.col("var").isin(list(others))))
    named = kept.withColumn("var", F.when(F.col("rule_kind") == "static", F.col("type")).otherwise(F.col("var")))
    periods = [*SIDES, *quarters]
    percent = named.select(*ids, "var", *[F.bround(F.col(f"`{p}`") * 100, 0).alias(p) for p in periods])
    long = percent.unpivot([*ids, "var"], [F.col(f"`{p}`") for p in periods], "period", "value")
    value = clip_below("value")
    return _zscore(long.withColumn("value", value), "value", ids, "fill")


def _zscore(df: DataFrame, c: str, by: Sequence[str], name: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)))


def max_regret(table: DataFrame, train: Sequence[str], test: Sequence[str]) -> DataFrame:
    """Worst regret of each rule within the training and the test quarters.

    Regret is the best value of a period minus the rule's own. Within a block of quarters the rows with the rule's
    largest regret are kept (ties too) and show that regret; single periods keep their value.
    """
    block = F.when(F.col("period").isin(list(train)), "Training MR").when(F.col("period").isin(list(test)), "Test MR")
    best = Window.partitionBy("lab", "lab2", "period")
    mine = Window.partitionBy("lab", "lab2", "var", "block")
    out = (
        table.drop("fill").withColumn("block", F.coalesce(block, F.col("period")))
        .withColumn("regret", _max_complete("value", best) - F.col("value"))
        .withColumn("max_regret", _max_complete("regret", mine))
    )
    is_block = F.col("block").endswith("MR")
    out = out.where(~is_block | (F.col("regret") == F.col("max_regret")))
    out = out.withColumn("value", F.when(is_block, F.col("max_regret")).otherwise(F.col("value")))
    shade = out.withColumn("good", F.when(is_block, 100 - F.col("value")).otherwise(F.col("value")))
    shade = _zscore(shade, "good", ["lab2", "block"], "fill")
    return shade.withColumn("fill", F.when(F.col("block").contains("Test"), F.col("fill"))).drop("good")


def time_trend(
    rows: DataFrame, adaptive: Sequence[str], hidden: Sequence[str] = (), metric: str = "Weighted accuracy",
    lab: str = "Neutral",
) -> DataFrame:
    """Quarterly scores with, per outcome, the refitted model that did best in training marked "Adaptive"."""
    kept = rows.where(
        (F.col("lab") == lab) & (F.col("metric") == metric) & ~F.col("quarter").isin("Test", "Overall")
        & ~F.col("var").isin(list(hidden)) & ((F.col("rule_kind") != "adaptive") | F.col("var").isin(list(adaptive)))
    ).withColumn("metric_value", F.round("metric_value", SCORE_DIGITS))
    own = Window.partitionBy("outcome_label", "var")
    outcome = Window.partitionBy("outcome_label")
    marked = kept.withColumn(
        "training", F.max(F.when(F.col("quarter") == "Training", F.col("metric_value"))).over(own)
    ).withColumn(
        "max_training", F.max(F.when(F.col("rule_kind") == "adaptive", F.col("training"))).over(outcome)
    ).withColumn("best_ind", F.col("training") == F.col("max_training"))
    parts = split_label(F.col("var"), ["c_level", "h_level", "o_level"])
    static = F.col("rule_kind") == "static"
    return marked.where("quarter <> 'Training'").select(
        "lab2", "outcome_label", "quarter", "var", "rule_kind", "best_ind",
        F.when(F.col("best_ind"), "Adaptive").otherwise(F.col("var")).alias("line"),
        F.when(static, parts["h_level"]).alias("h_level"),
        F.when(static, clip_below("metric_value")).otherwise(F.col("metric_value")).alias("metric_value"),
    )


def best_and_worst(rows: DataFrame, by: Sequence[str], var: str = "var", value: str = "metric_value") -> DataFrame:
    """Largest and smallest value with the rule that has it; among equals the first label."""
    v = F.round(value, SCORE_DIGITS)
    return rows.groupBy(*by).agg(
        F.max(v).alias("best_value"), F.min_by(var, F.struct(-v, F.col(var))).alias("best_var"),
        F.min(v).alias("worst_value"), F.min_by(var, F.struct(v, F.col(var))).alias("worst_var"),
    )


def range_of_best(rows: DataFrame, by: Sequence[str], period: str, value: str) -> DataFrame:
    """Smallest and largest over periods of each period's best value."""
    per_period = rows.groupBy(*by, period).agg(F.max(value).alias("best"), F.min(value).alias("worst"))
    return per_period.groupBy(*by).agg(
        F.min("best").alias("min_best"), F.max("best").alias("max_best"), F.min("worst").alias("min_worst"),
        F.count(F.lit(1)).alias("n_periods"))


def pareto_counts(points: DataFrame, by: Sequence[str], x: str = "Specificity", y: str = "Sensitivity") -> DataFrame:
    """How many rules of the same group are at least as good on both axes (the rule itself included).

    The group's rules are the cells of a threshold grid, a parameter of the study, so its points fit in one array.
    """
    side = points.groupBy(*by).agg(
        F.collect_list(F.struct(F.round(x, SCORE_DIGITS).alias("x"), F.round(y, SCORE_DIGITS).alias("y"))).alias("pts")
    ).select(*[F.col(b).alias(f"k_{b}") for b in by], "pts")
    joined = points.join(side, [F.col(b) == F.col(f"k_{b}") for b in by])
    here = (F.round(x, SCORE_DIGITS), F.round(y, SCORE_DIGITS))
    chk = F.size(F.filter("pts", lambda p: (p["x"] >= here[0]) & (p["y"] >= here[1])))
    return joined.withColumn("chk", chk).drop("pts", *[f"k_{b}" for b in by])


def sens_spec(rows: DataFrame, quarter: str, ids: Sequence[str]) -> DataFrame:
    """Sensitivity and specificity side by side for one period."""
    kept = rows.where((F.col("quarter") == quarter) & F.col("metric").isin("Sensitivity", "Specificity"))
    return to_wide(kept, ids, "metric", "metric_value", ["Sensitivity", "Specificity"])


def roc_points(
    roc: DataFrame, static: dict[str, tuple[DataFrame, dict[str, str]]], adaptive: str,
    blocked: dict[str, Sequence[float]], quarter: str = "Test",
) -> DataFrame:
    """Points of a ROC plot: the adaptive curve over cost ratios, the baselines, and one chosen static rule per
    source and outcome. ``static`` maps a source name to (neutral metric rows, outcome -> chosen rule)."""
    ids = ["outcome_label", "var", "mult"]
    curve = sens_spec(roc.where(F.col("var").isin(adaptive, "Community level", "Z")), quarter, ids)
    curve = curve.withColumn("source", F.col("var"))
    hide = F.lit(False)
    for outcome, cuts in blocked.items():
        hide = hide | ((F.col("outcome_label") == outcome) & F.col("mult").isin([float(c) for c in cuts]))
    out = curve.where(~hide)
    for name, (rows, chosen) in static.items():
        pts = sens_spec(rows.where(F.col("lab") == "Neutral"), quarter, ["outcome_label", "var", "mult"])
        pick = F.lit(False)
        for outcome, var in chosen.items():
            pick = pick | ((F.col("outcome_label") == outcome) & (F.col("var") == var))
        out = out.unionByName(pts.where(pick).withColumn("source", F.lit(name)))
    return out

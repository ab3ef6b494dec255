"""Indicator rules: threshold grids, the published rule and the current outcome."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.conditions import update_where
from riskpanel.functions.labels import number_text

# Outcome -> (current measure, cut): whether the outcome is happening now. Fixed values.
CURRENT_STATE = {
    "icu_2_time_3": ("icu_weekly", 2.0),
    "zeke_time_3": ("deaths_now_weekly", 1.0),
    "two_zeke_time_3": ("deaths_now_weekly", 2.0),
    "perc_covid_10_time_3": ("perc_covid_100", 10.0),
    "perc_covid_5_time_3": ("perc_covid_100", 5.0),
    "admits_time_3": ("admits_weekly", 10.0),
}
# The current-outcome *rule* knows only these; for every other outcome it is constant 0, while the model
# covariate knows all of CURRENT_STATE.
RULE_STATE = ("icu_2_time_3", "zeke_time_3", "two_zeke_time_3")
DEFAULT_OUTCOMES = ("zeke_time_3", "two_zeke_time_3", "icu_2_time_3", "perc_covid_10_time_3")
INDICATORS = {"case": "cases_weekly", "admit": "admits_weekly", "perc": "perc_covid_100"}


@dataclass(frozen=True)
class Grid:
    """Threshold levels per indicator; an unused indicator keeps the always-met level 0."""

    case: tuple[float, ...] = (0.0,)
    admit: tuple[float, ...] = (0.0,)
    perc: tuple[float, ...] = (0.0,)
    kind: str = field(default="rule", compare=False)

    def cells(self) -> list[tuple[float, float, float]]:
        return list(product(self.case, self.admit, self.perc))

    def label(self, cell: tuple[float, float, float]) -> str:
        return " ".join(number_text(x) for x in cell)


def current_state(outcome: Column, names: Sequence[str], covariate: bool) -> Column:
    """1 where the outcome is already happening, else 0; unknown measures give 0.

    Synthetic outcomes ``cutoffN`` take their lagged column ``lag_cutoffN``.
    """
    out = F.lit(0.0)
    for name in names:
        if name.startswith("cutoff"):
            out = update_where(out, outcome == name, F.col(f"lag_{name}").cast("double"))
        elif name in CURRENT_STATE and (covariate or name in RULE_STATE):
            measure, cut = CURRENT_STATE[name]
            out = update_where(out, (outcome == name) & (F.col(measure) > cut), F.lit(1.0))
    return out


def with_outcomes(panel: DataFrame, outcomes: Sequence[str] = DEFAULT_OUTCOMES) -> DataFrame:
    """One row per area, week and outcome: label, value (0/1/NULL), rule state and covariate state.

    The fan-out is an explode of a fixed-length array inside the scan stage.
    """
    pairs = F.array(*[F.struct(F.lit(o).alias("k"), F.col(o).cast("double").alias("v")) for o in outcomes])
    long = panel.withColumn("o", F.explode(pairs)).withColumns(
        {"outcome_label": F.col("o.k"), "outcome_value": F.col("o.v")}
    ).drop("o")
    label = F.col("outcome_label")
    return long.withColumns({
        "z_rule": current_state(label, outcomes, covariate=False),
        "z_cov": current_state(label, outcomes, covariate=True),
    })


def rule_array(grids: Sequence[Grid], fixed_rules: bool) -> Column:
    """Every rule of the grids as (kind, var, levels, value), three-valued: AND with a NULL input is false when
    another input already fails, else NULL."""
    rules = []
    for grid in grids:
        for cell in grid.cells():
            value = (
                (F.col(INDICATORS["case"]) >= cell[0])
                & (F.col(INDICATORS["admit"]) >= cell[1])
                & (F.col(INDICATORS["perc"]) >= cell[2])
            )
            rules.append(_rule(grid.kind, grid.label(cell), cell, value))
    if fixed_rules:
        rules.append(_rule("community", "cdc_flag", None, F.col("cdc_flag")))
        rules.append(_rule("current", "current_zeke", None, F.col("z_rule") > 0))
    return F.array(*rules)


def _rule(kind: str, var: str, cell: tuple[float, float, float] | None, value: Column) -> Column:
    levels = cell or (None, None, None)
    return F.struct(
        F.lit(kind).alias("rule_kind"), F.lit(var).alias("var"),
        *[F.lit(x).cast("double").alias(f"{n}_levels") for n, x in zip(INDICATORS, levels, strict=True)],
        value.alias("value"),
    )


def define_metrics(
    panel: DataFrame, grid: Grid, outcomes: Sequence[str] = DEFAULT_OUTCOMES, fixed_rules: bool = True
) -> DataFrame:
    """The long rule frame: panel x outcome x rule, with the rule's value and the outcome's value.

    For scoring use ``scoring.rule_sums``, which aggregates before it fans out over the grid.
    """
    long = with_outcomes(panel, outcomes).withColumn("r", F.explode(rule_array([grid], fixed_rules)))
    return long.select(
        *[c for c in long.columns if c not in ("r", "z_rule", "z_cov")],
        F.col("z_cov").alias("current_zeke"),
        "r.rule_kind", "r.var", "r.case_levels", "r.admit_levels", "r.perc_levels",
        F.col("r.value").cast("double").alias("value"),
    )


def reached_levels(grids: Sequence[Grid]) -> tuple[dict[str, Column], dict[str, list[float]]]:
    """Per indicator, the number of grid levels a row reaches (NULL stays NULL), and the levels themselves.

    Which rules of a grid a row meets depends on these few numbers only, so rows can be summed by them before they
    meet the rules.
    """
    levels = {n: sorted({x for g in grids for x in getattr(g, n)}) for n in INDICATORS}

    def reached(name: str) -> Column:
        c = F.col(INDICATORS[name])
        return sum((F.when(c >= x, 1).when(c.isNotNull(), 0) for x in levels[name]), F.lit(0))

    return {f"l_{n}": reached(n) for n in INDICATORS}, levels


def cell_rule(cell: tuple[float, float, float], levels: dict[str, list[float]]) -> Column:
    """A grid cell's rule on a row of reached levels."""
    met = F.lit(True)
    for n, x in zip(INDICATORS, cell, strict=True):
        met = met & (F.col(f"l_{n}") >= levels[n].index(x) + 1)
    return met


def rule_counts(panel: DataFrame, grid: Grid, by: dict[str, Column]) -> DataFrame:
    """True, false and unknown counts of every rule of a grid, by group."""
    reached, levels = reached_levels([grid])
    cells = panel.withColumns(by | reached).groupBy(*by, *reached).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[
        F.struct(
            F.lit(grid.label(c)).alias("var"),
            *[F.lit(x).alias(f"{n}_levels") for n, x in zip(INDICATORS, c, strict=True)],
            cell_rule(c, levels).alias("v"),
        )
        for c in grid.cells()
    ])
    fanned = cells.withColumn("r", F.explode(rules)).select(*by, "n", "r.*")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    v = F.col("v")
    return fanned.groupBy(*by, "var", *[f"{n}_levels" for n in INDICATORS]).agg(
        F.sum("n").alias("n"), total(v).alias("n_true"), total(~v).alias("n_false"), total(v.isNull()).alias("n_unknown"))

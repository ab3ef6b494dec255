"""The analysis matrix: thirteen numbered runs per geography and study period.

All runs are read off two stored cubes of additive sums: one of threshold rules, from one pass over the panels of all geographies, and one of
refitted models, from one pass over their predictions. Both keep quarters and the spans of time between the studies' limits, so studies, periods, preferences
and cost ratios are sums and filters of tables whose size is set by the parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.dates import quarter_label
from riskpanel.functions.labels import PREFERENCES
from riskpanel.operators import logistic as L
from riskpanel.operators import scoring as S
from riskpanel.operators.rules import DEFAULT_OUTCOMES, Grid, cell_rule, reached_levels, with_outcomes
from riskpanel.plans.estimates import NO_PREFERENCES, ROC_CUTS, Study

WEIGHTS = ("weight", "weight_alt")


@dataclass(frozen=True)
class Run:
    """``uses`` names the indicators with thresholds; ``weeks`` is the neutral window of the refitted models, if any."""

    number: int
    name: str
    uses: str
    weeks: int | None = None
    outcomes: tuple[str, ...] = DEFAULT_OUTCOMES
    equal_weight: bool = False
    prevalence: bool = False
    sweep: bool = False
    all_specs: bool = False  # every specification instead of the default ones


# The numbered runs.
RUNS = (
    Run(1, "base", "H", weeks=4, all_specs=True),
    Run(2, "w8", "H", weeks=8),
    Run(3, "w12", "H", weeks=12),
    Run(4, "C", "C"),
    Run(5, "CH", "CH"),
    Run(6, "CHO1", "CHO", outcomes=("zeke_time_3",)),
    Run(7, "CHO2", "CHO", outcomes=("two_zeke_time_3",)),
    Run(8, "CHO3", "CHO", outcomes=("icu_2_time_3",)),
    Run(9, "HO", "HO"),
    Run(10, "0", "", prevalence=True),
    Run(11, "uw", "H", weeks=4, equal_weight=True),
    Run(12, "roc", "H", weeks=4, outcomes=("zeke_time_3", "two_zeke_time_3"), sweep=True),
    Run(13, "CHO4", "CHO", outcomes=("perc_covid_10_time_3",)),
)


def grid_for(uses: str, case: Sequence[float], admit: Sequence[float], perc: Sequence[float]) -> Grid:
    off = (0.0,)
    return Grid(
        tuple(case) if "C" in uses else off, tuple(admit) if "H" in uses else off, tuple(perc) if "O" in uses else off,
        kind=uses or "Prev",
    )


def _marks(studies: dict[str, Study]) -> list[date]:
    """The first days of the spans of time into which the studies' ranges and splits cut the calendar."""
    day = timedelta(days=1)
    return sorted({d for s in studies.values() for d in (date.fromisoformat(s.start), date.fromisoformat(s.end) + day, date.fromisoformat(s.split) + day)})


def _with_spans(rows: DataFrame, studies: dict[str, Study]) -> DataFrame:
    marks = _marks(studies)
    span = sum((F.when(F.col("ymd") >= F.lit(m), 1).otherwise(0) for m in marks), F.lit(0))
    inside = (F.col("ymd") >= F.lit(marks[0])) & (F.col("ymd") < F.lit(marks[-1]))
    return rows.where(inside).withColumns({"span": span, "quarter_label": quarter_label(F.col("ymd"))})


def static_cube(
    panels: DataFrame, studies: dict[str, Study], levels: tuple[Sequence[float], Sequence[float], Sequence[float]], runs: Sequence[Run] = RUNS,
) -> DataFrame:
    """Sums of every rule of the runs by geography (``geo``), weighting, outcome, quarter and span. The panels are read once: rows are summed by the
    levels that they reach, for both weightings side by side, and the cells meet the rules."""
    grids = list({g.kind: g for g in (grid_for(r.uses, *levels) for r in runs)}.values())
    reached, cuts = reached_levels(grids)
    outcomes = list(dict.fromkeys(o for r in runs for o in r.outcomes))
    rows = with_outcomes(_with_spans(panels, studies), outcomes).withColumns(reached | {"y": F.col("outcome_value").cast("boolean"), "z": F.col("z_rule") > 0})
    keys = ["geo", "outcome_label", "quarter_label", "span"]
    cells = rows.groupBy(*keys, *reached, "cdc_flag", "z", "y").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(w).alias(f"n_{w}") for w in WEIGHTS], *[F.coalesce(F.sum(w), F.lit(0.0)).alias(f"w_{w}") for w in WEIGHTS])
    rules = [
        F.struct(F.lit(g.kind).alias("type"), F.lit("static").alias("rule_kind"), F.lit(g.label(c)).alias("var"), cell_rule(c, cuts).alias("v"))
        for g in grids for c in g.cells()
    ] + [
        F.struct(F.lit("").alias("type"), F.lit("baseline").alias("rule_kind"), F.lit(var).alias("var"), F.col(flag).alias("v"))
        for var, flag in (("cdc_flag", "cdc_flag"), ("current_zeke", "z"))
    ]
    weighted = F.array(*[F.struct(F.lit(w).alias("name"), F.col(f"n_{w}").alias("n"), F.col(f"w_{w}").alias("w")) for w in WEIGHTS])
    met = cells.withColumn("r", F.explode(F.array(*rules))).withColumn("s", F.explode(weighted)).select(
        *keys, F.col("s.name").alias("weighting"), "r.type", "r.rule_kind", "r.var", "n", F.col("s.n").alias("n_weight"), F.col("s.w").alias("w_all"),
        *S.sum_columns(F.col("r.v"), F.col("y"), F.col("s.w")))
    return S.add_sums(met, [*keys, "weighting", "type", "rule_kind", "var"])


def adaptive_cube(scored: DataFrame, studies: dict[str, Study], mults: Sequence[float]) -> DataFrame:
    """Sums of every refitted model and cost ratio by geography, weighting (that of the fit), outcome, quarter and span. A prediction becomes the number of
    cut-offs that it reaches, and the cells meet the ratios."""
    mults = sorted(set(map(float, mults)), reverse=True)
    pred = F.col("pred")
    reached = sum((F.when(L.predicted_class(pred, m), 1).when(pred.isNotNull(), 0) for m in mults), F.lit(0))
    weight = F.when(F.col("weight_name") == WEIGHTS[0], F.col(WEIGHTS[0])).otherwise(F.col(WEIGHTS[1]))
    keys = ["geo", "outcome_label", "quarter_label", "span", F.col("weight_name").alias("weighting"), "spec", "weeks"]
    cells = _with_spans(scored, studies).select(*keys, reached.alias("reached"), F.col("outcome_value").cast("boolean").alias("y"), weight.alias("w"))
    names = [*keys[:4], "weighting", "spec", "weeks"]
    cells = cells.groupBy(*names, "reached", "y").agg(
        F.count(F.lit(1)).alias("n"), F.count("w").alias("n_weight"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w_all"))
    cuts = F.array(*[F.struct(F.lit(m).alias("mult"), F.lit(i + 1).alias("need")) for i, m in enumerate(mults)])
    fanned = cells.withColumn("cut", F.explode(cuts)).select(
        *names, "cut.mult", "n", "n_weight", "w_all", *S.sum_columns(F.col("reached") >= F.col("cut.need"), F.col("y"), F.col("w_all")))
    return S.add_sums(fanned, [*names, "mult"])


def by_study(cube: DataFrame, studies: dict[str, Study]) -> DataFrame:
    """A cube's sums by study (``period``) and its parts: all, each side of the split, each quarter."""
    marks, day = _marks(studies), timedelta(days=1)
    at = lambda d, more: marks.index(date.fromisoformat(d) + more) + 1
    entries = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(at(s.start, 0 * day)).alias("lo"), F.lit(at(s.end, day)).alias("hi"), F.lit(at(s.split, day)).alias("test"))
        for name, s in studies.items()
    ])
    inside = cube.withColumn("p", F.explode(entries)).where((F.col("span") >= F.col("p.lo")) & (F.col("span") < F.col("p.hi")))
    sides = inside.withColumns({"period": F.col("p.name"), "split_label": F.when(F.col("span") >= F.col("p.test"), "Test").otherwise("Training")})
    ids = [c for c in cube.columns if c not in (*S.COUNTS, *S.SUMS, "span", "quarter_label")]
    return S.roll_up_periods(sides, ["period", *ids])


def _run_entries(runs: Sequence[Run]) -> Column:
    return F.array(*[
        F.struct(F.lit(r.number).alias("number"), F.lit(r.name).alias("name"), F.lit(r.uses or "Prev").alias("type"), F.lit(r.weeks).cast("int").alias("weeks"),
                 F.array(*map(F.lit, r.outcomes)).alias("outcomes"), F.lit(WEIGHTS[r.equal_weight]).alias("weighting"),
                 F.lit(r.prevalence).alias("prevalence"), F.lit(r.sweep).alias("sweep"), F.lit(r.all_specs).alias("all_specs"))
        for r in runs
    ])


def _costs(preferences: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("lab"), F.lit(float(m)).alias("mult")) for k, m in preferences.items()])


def static_runs(cube: DataFrame, studies: dict[str, Study], runs: Sequence[Run] = RUNS) -> DataFrame:
    """Metrics of the rules and baselines of all runs from the stored :func:`static_cube`."""
    rows = by_study(cube, studies).withColumn("run_of", F.explode(_run_entries(runs))).where(
        (F.col("weighting") == F.col("run_of.weighting")) & F.array_contains(F.col("run_of.outcomes"), F.col("outcome_label"))
        & ((F.col("type") == F.col("run_of.type")) | (F.col("rule_kind") == "baseline")))
    sweep = F.array(*[F.struct(F.lit(None).cast("string").alias("lab"), F.lit(float(c)).alias("mult")) for c in ROC_CUTS])
    costs = F.when(F.col("run_of.sweep"), sweep).when(F.col("run_of.prevalence"), _costs(NO_PREFERENCES)).otherwise(_costs(PREFERENCES))
    rows = rows.withColumn("cost", F.explode(costs)).withColumns({
        "type": F.col("run_of.type"), "lab": F.col("cost.lab"), "mult": F.col("cost.mult"), "run": F.col("run_of.name"), "run_number": F.col("run_of.number")})
    return S.rates(rows.drop("run_of", "cost", "weighting"), F.col("mult"))


def adaptive_runs(cube: DataFrame, studies: dict[str, Study], runs: Sequence[Run] = RUNS) -> DataFrame:
    """Metrics of the refitted models of all runs from the stored :func:`adaptive_cube`. Only the neutral preference uses a run's own window; the others keep
    four weeks."""
    own = [r for r in runs if r.weeks]
    rows = by_study(cube, studies).withColumn("run_of", F.explode(_run_entries(own))).where(
        (F.col("weighting") == F.col("run_of.weighting")) & F.array_contains(F.col("run_of.outcomes"), F.col("outcome_label"))
        & (F.col("run_of.all_specs") | F.col("spec").isin(*[s.name for s in L.DEFAULT_SPECS])))
    labs = F.array(*[F.struct(F.lit(k).alias("lab"), F.lit(float(m)).alias("mult"), F.lit(k == "Neutral").alias("neutral")) for k, m in PREFERENCES.items()])
    swept = F.array(F.struct(F.lit(None).cast("string").alias("lab"), F.col("mult").alias("mult"), F.lit(True).alias("neutral")))
    rows = rows.withColumn("cost", F.explode(F.when(F.col("run_of.sweep"), swept).otherwise(labs))).where(
        (F.col("mult") == F.col("cost.mult")) & (~F.col("run_of.sweep") | F.col("mult").isin(*map(float, ROC_CUTS)))
        & ((F.col("weeks") == 0) | (F.col("weeks") == F.when(F.col("cost.neutral"), F.col("run_of.weeks")).otherwise(4))))
    rows = rows.withColumns({
        "type": F.col("run_of.type"), "rule_kind": F.lit("adaptive"), "var": F.col("spec"), "lab": F.col("cost.lab"), "run": F.col("run_of.name"),
        "run_number": F.col("run_of.number")})
    return S.rates(rows.drop("run_of", "cost", "weighting", "spec", "weeks"), F.col("mult"))


def run_matrix(static: DataFrame, adaptive: DataFrame, studies: dict[str, Study], runs: Sequence[Run] = RUNS) -> DataFrame:
    """Metric rows of all runs, studies and geographies, tagged with the run, from the two stored cubes."""
    return S.to_metric_rows(static_runs(static, studies, runs).unionByName(adaptive_runs(adaptive, studies, runs)))


def fit_sets(runs: Sequence[Run] = RUNS) -> list[L.FitSet]:
    """The fits that the runs need: each window length and weighting with the specifications that use it."""
    base = [r for r in runs if r.weeks]
    every = any(r.all_specs for r in base)
    longer = tuple(sorted({r.weeks for r in base if not r.equal_weight} - {4}))
    weekly = tuple(s for s in L.DEFAULT_SPECS if not s.quarterly)
    sets = [L.FitSet(L.SPECS if every else L.DEFAULT_SPECS)]
    if longer:
        sets.append(L.FitSet(weekly, longer))
    if any(r.equal_weight for r in base):
        sets.append(L.FitSet(L.DEFAULT_SPECS, tuple(sorted({4, *(r.weeks for r in base if r.equal_weight)})), WEIGHTS[1]))
    return sets

"""Result tables assembled from panels, metric tables and scored predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.dates import quarter_label
from riskpanel.functions.labels import INDICATOR_NAMES, OUTCOME_NAMES, SPEC_NAMES, death_band, recode
from riskpanel.operators import logistic as L
from riskpanel.operators import scoring as S
from riskpanel.operators import synthetic as Y
from riskpanel.operators.ranking import exact_quantiles, ordered_positions
from riskpanel.operators.rules import Grid
from riskpanel.plans.estimates import NO_PREFERENCES, Study

# Outcomes predicted by the mortality and by the health-system specification.
MORTALITY = ("zeke_time_3", "two_zeke_time_3")
HEALTH = ("icu_2_time_3", "perc_covid_10_time_3")
BAND_INDICATORS = ("cases_weekly", "admits_weekly", "perc_covid_100")


def prevalence_rows(panel: DataFrame, study: Study, outcomes: Sequence[str]) -> DataFrame:
    """The always-on rule, which scores as the outcome's prevalence; it ignores cost preferences."""
    rows = S.static_metrics(panel, [Grid(kind="Prev")], study.start, study.end, study.split, outcomes,
                            NO_PREFERENCES, fixed_rules=False)
    return rows.withColumns({"var": F.lit("Prevalence"), "rule_kind": F.lit("prevalence")})


def predicted_calendar(scored: DataFrame, mortality_spec: str, health_spec: str, mult: float = 1.0) -> DataFrame:
    """One row per area, week and outcome: predicted class, what happened and the outcome's display label."""
    spec = F.when(F.col("outcome_label").isin(*MORTALITY), mortality_spec).when(
        F.col("outcome_label").isin(*HEALTH), health_spec)
    return scored.where(F.col("spec") == spec).select(
        "state", "ymd", "outcome_label", recode(F.col("outcome_label"), OUTCOME_NAMES).alias("lab2"),
        L.predicted_class(F.col("pred"), mult).alias("value"), F.col("outcome_value").cast("boolean").alias("happened"))


def with_spec_names(table: DataFrame, columns: Sequence[str] = ("var",)) -> DataFrame:
    """A result table with specifications under their display names."""
    return table.withColumns({c: recode(F.col(c), SPEC_NAMES) for c in columns})


def indicator_bands(panel: DataFrame, study: Study) -> DataFrame:
    """Long frame of the indicators with the band of the later death rate."""
    d = F.col("ymd")
    ids = ["state", "ymd", "POPESTIMATE2019", "deaths_weekly", "band"]
    in_range = panel.where((d >= F.lit(study.start).cast("date")) & (d <= F.lit(study.end).cast("date")))
    banded = in_range.withColumn("band", death_band(F.col("zeke_time_3"), F.col("two_zeke_time_3")))
    long = banded.unpivot(ids, list(BAND_INDICATORS), "var", "value")
    return long.withColumn("var2", recode(F.col("var"), INDICATOR_NAMES))


def band_quartiles(panel: DataFrame, study: Study) -> DataFrame:
    """Per week, indicator and band: median, quartiles, areas and the band's share of areas."""
    keys = ["ymd", "var2"]
    q = exact_quantiles(indicator_bands(panel, study), "value", [*keys, "band"], {"med": 0.5, "q25": 0.25, "q75": 0.75})
    total = q.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.sum("n").alias("total"))
    joined = q.join(total, [F.col(k) == F.col(f"k_{k}") for k in keys])
    return joined.select(*keys, "band", "med", "q25", "q75", "n", (F.col("n") / F.col("total") * 100).alias("perc"))


def loglog_points(panel: DataFrame, study: Study, min_population: float) -> DataFrame:
    """Log indicator against log later deaths for large areas; the log of 0 is NULL."""
    big = indicator_bands(panel, study).where(F.col("POPESTIMATE2019") > min_population)
    return big.select("state", "ymd", "var2", "band", quarter_label(F.col("ymd"), "-").alias("quarter"),
                      F.ln("value").alias("log_value"), F.ln("deaths_weekly").alias("log_deaths"))


def synthetic_outcomes(panel: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Panel with synthetic outcomes (probability at least one half) of each cut-off series and their lags."""
    schedules = Y.cutoff_schedules(ordered_positions(panel.select("ymd").distinct(), "ymd"))
    return Y.synthetic_outcomes(panel.select(*ids), schedules)

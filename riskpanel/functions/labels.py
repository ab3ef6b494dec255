"""Text labels, codes and ordered categories."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of metrics, outcomes and preference sets, in display order.
METRIC_NAMES = {
    "percright": "Accuracy",
    "w_acc": "Weighted accuracy",
    "ppv": "PPV",
    "npv": "NPV",
    "sens": "Sensitivity",
    "spec": "Specificity",
}
OUTCOME_NAMES = {
    "zeke_time_3": ">1 death/100K/wk",
    "two_zeke_time_3": ">2 deaths/100K/wk",
    "icu_2_time_3": ">2 ICU patients/100K/wk",
    "perc_covid_10_time_3": ">10% inpatient bed occupancy",
    "pred_rev": "Synthetic data",
}
PREFERENCES = {
    "Neutral": 1.0,
    "Don't cry wolf (0.5x FN)": 0.5,
    "Better safe than sorry (0.5x FP)": 2.0,
}
# Display names of the specifications whose own names do not list their covariates.
SPEC_NAMES = {
    "Adaptive": "Adaptive: HZ",
    "Adaptive.2": "Adaptive: HZD",
    "Simplified adaptive": "Simplified adaptive: HZ",
    "Simplified adaptive.2": "Simplified adaptive: HZD",
}
RULE_NAMES = {"cdc_flag": "Community level", "current_zeke": "Z"}
DEATH_BANDS = ["<1 death/100K/week", "1-2 deaths/100K/week", ">2 deaths/100K/week"]
INDICATOR_NAMES = {
    "cases_weekly": "Cases/100K",
    "admits_weekly": "Hospital admissions/100K",
    "perc_covid_100": "Percent bed occupancy",
    "icu_weekly": "ICU admissions/100K",
}


def recode(c: Column, names: dict[str, str], keep_other: bool = True) -> Column:
    """Value -> display name through a literal map."""
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    named = F.try_element_at(lookup, c)
    return F.coalesce(named, c) if keep_other else named


def ordinal(c: Column, levels: Sequence[str], reverse: bool = False) -> Column:
    """1-based position of a label among its levels; NULL for a label that is not a level."""
    order = list(reversed(levels)) if reverse else list(levels)
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable((v, i + 1) for i, v in enumerate(order))])
    return F.try_element_at(lookup, c)


def number_text(x: float) -> str:
    """5.0 -> "5", 0.5 -> "0.5"."""
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def rule_label(*cols: Column | str, sep: str = " ") -> Column:
    """Joined text in which a missing part is written NA."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def split_label(c: Column, names: Sequence[str], sep: str = " ") -> dict[str, Column]:
    """One column per part; short labels are padded with NULL."""
    parts = F.split(c, sep)
    return {name: F.get(parts, F.lit(i)) for i, name in enumerate(names)}


def code_number(c: Column, prefix: str = "") -> Column:
    """Text code -> integer: a known prefix is removed, leading zeros drop, bad text gives NULL."""
    text = F.regexp_replace(c, f"^{prefix}", "") if prefix else c
    return text.try_cast("int")


def death_band(above_one: Column, above_two: Column) -> Column:
    return (
        F.when(above_two, DEATH_BANDS[2])
        .when(above_one & ~above_two, DEATH_BANDS[1])
        .when(~above_one & ~above_two, DEATH_BANDS[0])
    )

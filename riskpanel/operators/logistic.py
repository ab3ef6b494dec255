"""Many weighted logistic regressions at once.

Every (evaluation date x outcome x specification) is one fit. All fits advance together: an iteration is one pass
over the training rows that sums, per fit, the normal equations of the next weighted least-squares step. Rows lie in blocks
of one date and outcome, and a block adds itself to all fits that it trains by a few matrix products. Sums
combine within a task, so neither an area nor a fit has to be gathered in one place; what is left per fit is a row of
about fifty numbers, solved in batches on the executors.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.operators.rules import DEFAULT_OUTCOMES, with_outcomes
from riskpanel.operators.training import in_windows, quarterly_windows, weekly_windows
from riskpanel.session import materialize

# The solver travels with its tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Feature columns and the named specifications over them.
FEATURES = {
    "c": "cases_weekly", "h": "admits_weekly", "o": "perc_covid_100", "z": "current_zeke",
    "dh": "change_admits", "do": "change_perc", "dc": "change_cases",
}


@dataclass(frozen=True)
class Spec:
    name: str
    features: tuple[str, ...]
    quarterly: bool = False


SPECS = (
    Spec("Adaptive", ("h", "z")),
    Spec("Adaptive: H", ("h",)),
    Spec("Adaptive: C", ("c",)),
    Spec("Adaptive: CZ", ("c", "z")),
    Spec("Adaptive: CH", ("c", "h")),
    Spec("Adaptive: CHZ", ("c", "h", "z")),
    Spec("Adaptive: HO", ("h", "o")),
    Spec("Adaptive: HOZ", ("h", "o", "z")),
    Spec("Adaptive: CHO", ("c", "h", "o")),
    Spec("Adaptive: CHOZ", ("c", "h", "o", "z")),
    Spec("Adaptive.2", ("h", "z", "dh")),
    Spec("Adaptive: CHOD", ("c", "h", "o", "dh", "do", "dc")),
    Spec("Adaptive: CHODZ", ("c", "h", "o", "z", "dh", "do", "dc")),
    Spec("Simplified adaptive", ("h", "z"), quarterly=True),
    Spec("Simplified adaptive.2", ("h", "z", "dh"), quarterly=True),
)
DEFAULT_SPECS = tuple(SPECS[i - 1] for i in (1, 9, 10, 12, 14))

_X = ["one", *[f"x_{f}" for f in FEATURES]]
_P = len(_X)
_PAIRS = list(combinations_with_replacement(range(_P), 2))
_B = [f"b{j}" for j in range(_P)]
_M = [f"m_{f}" for f in FEATURES]
_G = [f"g{j}_{k}" for j, k in _PAIRS]
_R = [f"r{j}" for j in range(_P)]
_SUMS = [*_G, *_R, "dev", "n_rows"]
_MAX_ETA = 30.0
BLOCK_ROWS = 4096
TASK_ROWS = 16_384  # a row is met by dozens of fits, so a task takes few of them
# A column whose remaining sum of squares falls below this share of its own is a combination of earlier ones.
ALIAS_TOL = 1e-13


def spec(name: str) -> Spec:
    return next(s for s in SPECS if s.name == name)


def model_rows(panel: DataFrame, outcomes: Sequence[str] = DEFAULT_OUTCOMES) -> DataFrame:
    """Panel x outcome with the model covariate ``current_zeke``."""
    return with_outcomes(panel, outcomes).withColumn("current_zeke", F.col("z_cov")).drop("z_rule", "z_cov")


def complete_rows(rows: DataFrame, specs: Sequence[Spec] = SPECS) -> DataFrame:
    """Specification table with the number of rows that have every feature, from counts by pattern of known ones."""
    known = [F.col(c).isNotNull().alias(f"k_{f}") for f, c in FEATURES.items()]
    patterns = rows.select(*known).groupBy(*[f"k_{f}" for f in FEATURES]).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array(*[
        F.struct(F.lit(i).alias("spec_id"), F.lit(s.name).alias("spec"), F.lit(s.quarterly).alias("quarterly"),
                 F.lit(len(s.features)).alias("n_features"),
                 _all([F.col(f"k_{f}") for f in s.features]).alias("complete"))
        for i, s in enumerate(specs, 1)
    ])
    return patterns.withColumn("s", F.explode(entries)).groupBy(
        "s.spec_id", "s.spec", "s.quarterly", "s.n_features"
    ).agg(F.sum(F.when(F.col("s.complete"), F.col("n")).otherwise(0)).alias("n_complete"))


def _all(conds: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


@dataclass(frozen=True)
class FitSet:
    """Fits that share window lengths and a weighting."""

    specs: tuple[Spec, ...] = DEFAULT_SPECS
    weeks: tuple[int, ...] = (4,)
    weight: str = "weight"


def fit_table(dates: DataFrame, specs: Sequence[Spec], outcomes: Sequence[str], weeks: Sequence[int]) -> DataFrame:
    """One row per fit: window, specification, outcome and which features it uses."""
    def entries(quarterly: bool) -> Column:
        return F.array(*[
            F.struct(F.lit(s.name).alias("spec"), F.lit(o).alias("outcome_label"),
                     *[F.lit(f in s.features).alias(f"m_{f}") for f in FEATURES])
            for s in specs if s.quarterly == quarterly for o in outcomes
        ])

    parts = []
    if any(not s.quarterly for s in specs):
        parts += [weekly_windows(dates, w).withColumn("s", F.explode(entries(False))) for w in weeks]
    if any(s.quarterly for s in specs):
        parts.append(quarterly_windows(dates).withColumn("s", F.explode(entries(True))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    fits = out.select("end_date", "weeks", "window_key", "lo_date", "hi_date", "s.*")
    return fits.withColumn("fit_id", F.concat_ws("|", "spec", "outcome_label", "weeks", "end_date"))


def packed_rows(rows: DataFrame, weights: Sequence[str]) -> DataFrame:
    """Training rows in blocks of at most ``BLOCK_ROWS`` rows of one group, outcome and date: ``data`` holds the label, the weights and the
    features of a block as doubles, row by row, NaN for NULL."""
    columns = ["y", *weights, *[f"x_{f}" for f in FEATURES]]
    schema = pa.schema([("grp", pa.string()), ("outcome_label", pa.string()), ("ymd", pa.date32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
            keys = [batch.column(c).to_pylist() for c in ("grp", "outcome_label", "ymd")]
            cuts = [0, *[i for i in range(1, len(batch)) if any(k[i] != k[i - 1] for k in keys)], len(batch)]
            out = []
            for a, z in zip(cuts, cuts[1:]):
                for at in range(a, z, BLOCK_ROWS):
                    out.append((*[k[a] for k in keys], values[at:min(at + BLOCK_ROWS, z)].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    tasks = max(1, -(-rows.count() // TASK_ROWS))
    ordered = rows.repartitionByRange(tasks, "grp", "outcome_label", "ymd", F.xxhash64(*columns)).sortWithinPartitions("grp", "outcome_label", "ymd")
    return ordered.select("grp", "outcome_label", "ymd", *columns).mapInArrow(run, "grp string, outcome_label string, ymd date, data binary")


def _partial_sums(n_weights: int, first: bool):
    """Adds up, for the blocks of a task, the normal equations of all fits that they train; one row per fit and task leaves it."""
    pairs = np.array(_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[int, int] = {}
        total = np.zeros((256, len(_SUMS)))
        for batch in batches:
            lists = batch.column("fits")
            ends, fits = lists.offsets.to_numpy(), lists.values
            numbers, weight_at, masks = (fits.field(c).to_numpy(zero_copy_only=False) for c in ("fit_no", "w", "mask"))
            betas = fits.field("b").flatten().to_numpy(zero_copy_only=False).reshape(-1, _P)
            for i, data in enumerate(batch.column("data")):
                rows = np.frombuffer(data.as_buffer(), float).reshape(-1, 1 + n_weights + len(FEATURES))
                y = rows[:, :1]
                x = np.column_stack([np.ones(len(rows)), rows[:, 1 + n_weights:]])
                missing = np.isnan(x) @ (1 << np.arange(_P))
                x = np.nan_to_num(x)
                products = x[:, pairs[:, 0]] * x[:, pairs[:, 1]]
                for at in range(ends[i], ends[i + 1], 64):
                    part = slice(at, min(at + 64, ends[i + 1]))
                    w = rows[:, 1 + weight_at[part]]
                    ok = ((missing[:, None] & masks[None, part]) == 0) & (w > 0)
                    w = np.where(ok, w, 0.0)
                    if first:  # usual start of a binomial fit: each row's own weighted label, pulled towards one half
                        eta, mu = np.log((w * y + 0.5) / (w * (1 - y) + 0.5)), (w * y + 0.5) / (w + 1)
                    else:
                        eta = np.clip(x @ betas[part].T, -_MAX_ETA, _MAX_ETA)
                        mu = 1 / (1 + np.exp(-eta))
                    iw = w * mu * (1 - mu)
                    iz = iw * eta + w * (y - mu)
                    deviance = -2 * w * np.log(np.where(y == 1, mu, 1 - mu))
                    sums = np.column_stack([iw.T @ products, iz.T @ x, deviance.sum(axis=0), ok.sum(axis=0)])
                    where = [slots.setdefault(int(k), len(slots)) for k in numbers[part]]
                    if len(slots) > len(total):
                        total = np.concatenate([total, np.zeros((max(len(total), len(slots)), len(_SUMS)))])
                    total[where] += sums  # a fit comes once a block
        if slots:
            yield pa.RecordBatch.from_arrays([pa.array(list(slots), pa.int64()), *[pa.array(c) for c in total[:len(slots)].T]], ["fit_no", *_SUMS])

    return run


def _normal_equations(packed: DataFrame, keys: DataFrame, fits: DataFrame, max_weeks: int, weights: Sequence[str], first: bool) -> DataFrame:
    """Per fit: X'WX, X'Wz, deviance and row count at the current coefficients. Each block meets the fits that it trains as one list."""
    weight_at = F.array_position(F.array(*map(F.lit, weights)), F.col("weight_name")).cast("int") - 1
    mask = sum((F.when(F.col(m), 2 << j).otherwise(0) for j, m in enumerate(_M)), F.lit(1))
    side = fits.select("grp", "outcome_label", "window_key", "lo_date", "hi_date", F.struct(
        "fit_no", weight_at.alias("w"), mask.cast("long").alias("mask"), F.array(*_B).alias("b")).alias("fit"))
    met = in_windows(keys, side, max_weeks, on=("grp", "outcome_label")).groupBy("grp", "outcome_label", "ymd").agg(F.collect_list("fit").alias("fits"))
    schema = "fit_no long, " + ", ".join(f"{c} double" for c in _SUMS)
    partial = packed.join(met, ["grp", "outcome_label", "ymd"]).select("data", "fits").mapInArrow(_partial_sums(len(weights), first), schema)
    sums = ", ".join(f"sum({c}) AS {c}" for c in _SUMS)
    # One SQL text instead of fifty column objects: this plan is built once per step.
    return packed.sparkSession.sql(f"SELECT fit_no, {sums} FROM {{partial}} GROUP BY fit_no", partial=partial).where("n_rows > 0")


def solve_systems(gram: np.ndarray, rhs: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Batched symmetric elimination in column order; unused and aliased columns get coefficient 0."""
    n, p = rhs.shape
    scale = np.sqrt(np.where(np.einsum("ijj->ij", gram) > 0, np.einsum("ijj->ij", gram), 1.0))
    a = np.concatenate([gram / (scale[:, :, None] * scale[:, None, :]), (rhs / scale)[:, :, None]], axis=2)
    kept = np.zeros((n, p), dtype=bool)
    for j in range(p):
        pivot = a[:, j, j].copy()
        ok = used[:, j] & (pivot > ALIAS_TOL)
        kept[:, j] = ok
        row = np.where(ok[:, None], a[:, j, :] / np.where(ok, pivot, 1.0)[:, None], 0.0)
        factor = a[:, :, j].copy()
        factor[:, j] = 0.0
        a -= np.where(ok[:, None, None], factor[:, :, None] * row[:, None, :], 0.0)
        a[:, j, :] = np.where(ok[:, None], row, a[:, j, :])
    return np.where(kept, a[:, :, p] / scale, 0.0), kept


def _advance(step: int, tol: float, max_iter: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[_FIT_COLUMNS].copy()
            has = pdf["n_rows"].notna().to_numpy()
            dev = pdf["dev"].to_numpy(float)
            old = pdf["old_dev"].to_numpy(float)
            with np.errstate(invalid="ignore"):
                done = has & (step > 0) & (np.abs(dev - old) / (np.abs(dev) + 0.1) < tol)
            go = has & ~done & (step < max_iter)
            if go.any():
                sub = pdf[go]
                gram = np.zeros((len(sub), _P, _P))
                for (j, k), g in zip(_PAIRS, _G, strict=True):
                    gram[:, j, k] = gram[:, k, j] = sub[g].to_numpy(float)
                used = np.column_stack([np.ones(len(sub), bool), sub[_M].to_numpy(bool)])
                beta, kept = solve_systems(gram, sub[_R].to_numpy(float), used)
                for j, b in enumerate(_B):
                    out.loc[go, b] = beta[:, j]
                out.loc[go, "n_aliased"] = (used & ~kept).sum(axis=1).astype("int32")
                out.loc[go, "iterations"] = step + 1
            out["old_dev"] = np.where(has, dev, np.nan)
            out["n_train"] = pdf["n_rows"].fillna(0).astype("int64")
            out["state"] = np.where(done, "converged", np.where(go, "active", np.where(has, "stopped", "empty")))
            yield out

    return run


_FIT_SCHEMA = (
    "fit_no long, fit_id string, grp string, weight_name string, spec string, outcome_label string, weeks int, end_date date, window_key int, lo_date date, "
    "hi_date date, " + ", ".join(f"{m} boolean" for m in _M) + ", " + ", ".join(f"{b} double" for b in _B)
    + ", old_dev double, n_train long, n_aliased int, iterations int, state string"
)
_FIT_COLUMNS = [c.split()[0] for c in _FIT_SCHEMA.split(", ")]


def fit_logistic(
    rows: DataFrame, dates: DataFrame, specs: Sequence[Spec] = DEFAULT_SPECS,
    outcomes: Sequence[str] = DEFAULT_OUTCOMES, weeks: Sequence[int] = (4,), weight: str = "weight",
    tol: float = 1e-8, max_iter: int = 25,
) -> DataFrame:
    """Coefficients of every fit.

    ``rows`` is the panel by outcome (``model_rows``), ``dates`` the evaluation dates. A fit stops when its deviance
    changes by less than ``tol`` relative, or after ``max_iter`` steps; finished fits leave the iteration.
    """
    sets = [FitSet(tuple(specs), tuple(weeks), weight)]
    return fit_sets(rows.withColumn("grp", F.lit("")), dates, sets, [""], outcomes, tol, max_iter).drop("fit_no", "grp", "weight_name")


def fit_sets(
    rows: DataFrame, dates: DataFrame, sets: Sequence[FitSet], groups: Sequence[str], outcomes: Sequence[str] = DEFAULT_OUTCOMES,
    tol: float = 1e-8, max_iter: int = 25,
) -> DataFrame:
    """Coefficients of several sets of fits for each group of rows (column ``grp``, such as a geography), all in the same steps: a step costs about
    the same for one set of one group as for all. The result names the weighting of a set in ``weight_name``."""
    max_weeks = max(w for s in sets for w in s.weeks)
    weights = sorted({s.weight for s in sets})
    blank = {b: F.lit(0.0) for b in _B} | {
        "old_dev": F.lit(None).cast("double"), "n_train": F.lit(0).cast("long"), "n_aliased": F.lit(0),
        "iterations": F.lit(0), "state": F.lit("active"), "grp": F.explode(F.array(*map(F.lit, groups))),
    }
    tables = [fit_table(dates, s.specs, outcomes, s.weeks).withColumn("weight_name", F.lit(s.weight)) for s in sets]
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t)
    active = materialize(table.withColumns(blank).withColumn("fit_no", F.monotonically_increasing_id()).select(*_FIT_COLUMNS), "fits")
    span = active.agg(F.min("lo_date"), F.max("hi_date")).first()  # two dates
    known = F.col("outcome_value").isNotNull() & (F.col("ymd") > F.lit(span[0])) & (F.col("ymd") <= F.lit(span[1]))
    training = rows.where(known).select(
        "grp", "outcome_label", "ymd", F.col("outcome_value").cast("double").alias("y"), *[F.col(w).cast("double").alias(w) for w in weights],
        *[F.col(c).cast("double").alias(f"x_{f}") for f, c in FEATURES.items()])
    packed = materialize(packed_rows(training, weights), "training_blocks")
    keys = materialize(packed.select("grp", "outcome_label", "ymd").distinct(), "training_dates")
    finished: list[DataFrame] = []
    for step in range(max_iter + 1):
        sums = _normal_equations(packed, keys, active, max_weeks, weights, first=step == 0)
        stepped = active.join(sums, "fit_no", "left").mapInPandas(_advance(step, tol, max_iter), _FIT_SCHEMA)
        table = materialize(stepped, f"fits_{step}", partition_by=["state"]).select(*_FIT_COLUMNS)
        finished.append(table.where("state <> 'active'"))
        active = table.where("state = 'active'")
        if active.isEmpty():
            break
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("old_dev", "deviance").drop("window_key")


def score(rows: DataFrame, fits: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Predicted probability of each row of an evaluation date under every fit of that date; ``on`` adds equality columns present on both
    sides, and ``weight_name`` of the fits is kept.

    A row that lacks a used feature, or whose fit had no training rows, gets a NULL prediction.
    """
    eta = F.col("b0")
    for (f, c), b in zip(FEATURES.items(), _B[1:], strict=True):
        eta = eta + F.when(F.col(f"m_{f}"), F.col(b) * F.col(c)).otherwise(0.0)
    side = fits.select(
        F.when(F.col("state") != "empty", True).alias("fitted"), "spec", "weeks", F.col("outcome_label").alias("k_outcome"), F.col("end_date").alias("test_date"),
        "n_train", *_M, *_B, *[F.col(c).alias(f"k_{c}") for c in on], *[c for c in fits.columns if c == "weight_name"],
    )
    met = (F.col("outcome_label") == F.col("k_outcome")) & (F.col("ymd") == F.col("test_date"))
    for c in on:
        met = met & (F.col(c) == F.col(f"k_{c}"))
    joined = rows.join(side, met)
    return joined.withColumn("pred", F.when(F.col("fitted"), 1 / (1 + F.exp(-eta)))).drop("fitted", "k_outcome", *[f"k_{c}" for c in on], *_M, *_B)


def predicted_class(pred: Column, mult: Column | float) -> Column:
    """Positive from the probability at which a false negative, ``mult`` times as costly, outweighs a false one."""
    m = F.lit(float(mult)) if isinstance(mult, (int, float)) else mult
    return pred >= 1 / (1 + m)

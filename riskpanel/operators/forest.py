"""Random-forest variant of the refitted models: the forests of all training windows and outcomes grow in the same jobs.

1. Feature values become bins between quantiles of their window and outcome (at most ``BINS``).
2. One pass over the training rows draws how often each tree takes a row (Poisson with mean 1, from a hash of the row) and sums the weights by
   (window, outcome, fold, tree, bins) and label. From here on the rows are not read again: these cells are bounded by the bins.
3. Level by level, every node's histograms by (feature, bin) are summed, the split with the largest loss of Gini impurity among the node's
   drawn features is taken, and the cells move to its children. A job a level serves all windows, outcomes, trees, folds and candidates.
4. Test rows are reduced to their distinct bins, which walk down the trees; a prediction is the mean of the leaves' shares.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.session import literal_table, materialize

BINS = 32
FOLDS = 5
# Cumulative Poisson(1) probabilities: a uniform number counts as many draws as it passes.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)
KEY = ["window_no", "outcome_label"]
FIT = [*KEY, "m", "left_out"]  # candidate number of features; the fold left out, -1 for none
TREE = [*FIT, "tree"]


@dataclass(frozen=True)
class Refit:
    """Train on (lo, hi], predict the dates first..last."""

    lo: date
    hi: date
    first: date
    last: date


def date_refits(windows: DataFrame) -> list[Refit]:
    """A refit for every date, trained on the date's own window. Dates with the same window share one, as they share its training rows.

    A window of the quarter before (``weeks`` 0) ends with that quarter. The result has at most one row per evaluation date."""
    end_of_quarter = F.date_sub(F.add_months(F.date_add("lo_date", 1), 3), 1)
    hi = F.when(F.col("weeks") == 0, F.least("hi_date", end_of_quarter)).otherwise(F.col("hi_date"))
    rows = windows.groupBy("lo_date", hi.alias("hi")).agg(F.min("end_date").alias("first"), F.max("end_date").alias("last")).orderBy("first").collect()
    return [Refit(r["lo_date"], r["hi"], r["first"], r["last"]) for r in rows]


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from a hash of ``keys``."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 31)) / float(1 << 31)


def _bins(n: int) -> list[str]:
    return [f"bin_{i}" for i in range(n)]


def training_cells(binned: DataFrame, k: int, n_trees: int, seed: int) -> DataFrame:
    """Sums ``w0``, ``w1`` of drawn weights by label, per window, outcome, fold, tree and bins."""
    trees = binned.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(n_trees))))
    u = uniform(F.lit(seed), *[F.col(c) for c in KEY], F.col("tree"), F.col("row_hash"))
    times = reduce(lambda a, b: a + b, [(u >= t).cast("int") for t in POISSON])
    drawn = trees.withColumn("taken", F.col("w") * times).where("taken > 0")
    return drawn.groupBy(*KEY, "fold", "tree", *_bins(k)).agg(*_by_label("taken"))


def _by_label(weight: str) -> list[Column]:
    return [F.sum(F.when(F.col("y") == 0, F.col(weight)).otherwise(0.0)).alias("w0"), F.sum(F.when(F.col("y") == 1, F.col(weight)).otherwise(0.0)).alias("w1")]


def _mixed(a: Column, b: Column) -> Column:
    """Gini impurity times weight of ``a`` and ``b`` by label."""
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def best_splits(cells: DataFrame, k: int, seed: int) -> DataFrame:
    """``split_on`` and ``split_at`` (bins up to it go left) of every node of ``cells`` that a split improves."""
    node = [*TREE, "node"]
    ranked = F.array_sort(F.array(*[F.struct(F.xxhash64(F.lit(seed), *[F.col(c) for c in (*KEY, "tree", "node")], F.lit(i)), F.lit(i).alias("i")) for i in range(k)]))
    asked = cells.withColumn("split_on", F.explode(F.transform(F.slice(ranked, F.lit(1), F.col("m")), lambda s: s["i"])))
    hist = asked.withColumn("split_at", F.get(F.array(*_bins(k)), F.col("split_on"))).groupBy(*node, "split_on", "split_at").agg(
        F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    whole = Window.partitionBy(*node, "split_on")  # at most BINS rows
    upto = whole.orderBy("split_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = hist.select(*node, "split_on", "split_at", F.sum("w0").over(whole).alias("t0"), F.sum("w1").over(whole).alias("t1"),
                       F.sum("w0").over(upto).alias("l0"), F.sum("w1").over(upto).alias("l1"), F.max("split_at").over(whole).alias("last"))
    c = F.col
    gain = _mixed(c("t0"), c("t1")) - _mixed(c("l0"), c("l1")) - _mixed(c("t0") - c("l0"), c("t1") - c("l1"))
    useful = sums.withColumn("gain", gain).where("split_at < last AND gain > 1e-9 * (t0 + t1)")
    return useful.groupBy(*node).agg(F.max_by(F.struct("split_on", "split_at"), F.struct(F.round("gain", 12), -c("split_on"), -c("split_at"))).alias("s")).select(*node, "s.*")


def step_down(cells: DataFrame, splits: DataFrame, k: int) -> DataFrame:
    """``cells`` with ``node`` moved to the child their bins lead to; a node without a split keeps them."""
    value = F.get(F.array(*_bins(k)), F.col("split_on"))
    to = F.when(F.col("split_on").isNull(), F.col("node")).otherwise(2 * F.col("node") + (value > F.col("split_at")).cast("int"))
    return cells.join(splits, [*TREE, "node"], "left").withColumn("node", to).drop("split_on", "split_at")


def grow(cells: DataFrame, k: int, max_depth: int, seed: int) -> tuple[list[DataFrame], DataFrame]:
    """The splits of each level, and the leaves with their share ``p`` of label 1."""
    at, levels = cells.withColumn("node", F.lit(1)), []
    for depth in range(max_depth):
        levels.append(materialize(best_splits(at, k, seed), f"forest_splits_{depth}"))
        at = materialize(step_down(at, levels[-1], k), f"forest_cells_{depth}")
    leaves = at.groupBy(*TREE, "node").agg((F.sum("w1") / (F.sum("w0") + F.sum("w1"))).alias("p"))
    return levels, materialize(leaves, "forest_leaves")


def predict(cells: DataFrame, levels: Sequence[DataFrame], leaves: DataFrame, k: int) -> DataFrame:
    """Mean leaf share ``p`` of each distinct row of ``cells`` (fit and bins). Each tree has at least its root as a leaf."""
    trees = leaves.select(*TREE).distinct()
    at = cells.join(trees, FIT).withColumn("node", F.lit(1))
    for splits in levels:
        at = step_down(at, splits, k)
    # A child that no training cell reached cannot be met: a split lies between two bins that both have weight.
    return at.join(leaves, [*TREE, "node"]).groupBy(*FIT, *_bins(k)).agg(F.avg("p").alias("p"))


def forest_scores(
    rows: DataFrame, refits: Sequence[Refit], outcomes: Sequence[str], features: Sequence[str], weight: str = "weight",
    mtry: int = 1, n_trees: int = 100, max_depth: int = 3, seed: int = 123,
) -> DataFrame:
    """Predicted probability per test row. With more than one ``mtry`` candidate, 5-fold cross-validation by weighted accuracy picks
    for each window and outcome, ties to the smaller.

    Without refits there are no rows. A training set with a single label predicts that label; one without rows of positive weight predicts NULL, and so does a test row
    that lacks a feature. Rows that are equal in every column are drawn together.
    """
    spark, names, k = rows.sparkSession, rows.columns, len(features)
    b, c = _bins(k), F.col
    if not refits:
        return rows.where(F.lit(False)).withColumn("pred", F.lit(None).cast("double"))
    table = literal_table(spark, [(i, r.lo, r.hi, r.first, r.last) for i, r in enumerate(refits)], "window_no int, lo date, hi date, first date, last date")
    train_days = table.where("hi > lo").select("window_no", F.explode(F.sequence(F.date_add("lo", 1), c("hi"))).alias("ymd"))
    test_days = table.where("last >= first").select("window_no", F.explode(F.sequence("first", "last")).alias("ymd"))
    base = rows.where(c("outcome_label").isin(*outcomes))
    x = [c(f).cast("double") for f in features]
    known = reduce(and_, [v.isNotNull() for v in x]) & c("outcome_value").isNotNull() & (c(weight) > 0)
    row_hash = F.xxhash64(*[c(f"`{n}`") for n in names])
    train = base.where(known).select("outcome_label", "ymd", c("outcome_value").cast("double").alias("y"), c(weight).cast("double").alias("w"), row_hash.alias("row_hash"),
                                     *[v.alias(f"x_{i}") for i, v in enumerate(x)]).join(train_days, "ymd")
    quantiles = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    cuts = materialize(train.groupBy(*KEY).agg(
        F.min("y").alias("y_lo"), F.max("y").alias("y_hi"),
        *[F.array_distinct(F.percentile_approx(f"x_{i}", quantiles, 10000)).alias(f"cuts_{i}") for i in range(k)]), "forest_cuts")

    def in_bins(values: DataFrame) -> DataFrame:
        below = lambda i: F.size(F.filter(f"cuts_{i}", lambda q: q < c(f"x_{i}")))
        return values.withColumns({n: below(i) for i, n in enumerate(b)})

    n_folds = FOLDS if mtry > 1 else 1
    candidates = range(1, min(mtry, k) + 1)
    binned = in_bins(train.join(cuts.where("y_lo < y_hi"), KEY)).withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "row_hash"), F.lit(n_folds)).cast("int"))
    fits = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(o).alias("left_out")) for m in candidates for o in ([-1, *range(n_folds)] if len(candidates) > 1 else [-1])])
    cells = materialize(training_cells(binned, k, n_trees, seed), "forest_drawn")
    cells = cells.select("*", F.inline(fits)).where("left_out <> fold").groupBy(*TREE, *b).agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    levels, leaves = grow(materialize(cells, "forest_cells"), k, max_depth, seed)

    if len(candidates) > 1:
        held = binned.groupBy(*KEY, c("fold").alias("left_out"), *b).agg(*_by_label("w"))
        asked = held.withColumn("m", F.explode(F.array(*map(F.lit, candidates))))
        judged = asked.join(predict(asked.select(*FIT, *b), levels, leaves, k), [*FIT, *b])
        right = F.sum(F.when(c("p") > 0.5, c("w1")).otherwise(c("w0"))) / F.sum(c("w0") + c("w1"))
        picked = judged.groupBy(*KEY, "m").agg(F.round(right, 9).alias("accuracy")).groupBy(*KEY).agg(
            F.max_by("m", F.struct("accuracy", -c("m"))).alias("m"))
        picked = materialize(picked, "forest_picked")
    else:
        picked = cuts.select(*KEY, F.lit(1).alias("m"))
    test = base.join(test_days, "ymd").withColumns({f"x_{i}": v for i, v in enumerate(x)}).join(cuts, KEY, "left")
    test = in_bins(test.withColumns({f"cuts_{i}": F.when(c(f"x_{i}").isNotNull(), c(f"cuts_{i}")) for i in range(k)}))
    wanted = test.where(reduce(and_, [c(f"cuts_{i}").isNotNull() for i in range(k)])).select(*KEY, *b).distinct().join(picked, KEY).withColumn("left_out", F.lit(-1))
    scores = predict(wanted, levels, leaves, k).select(*KEY, *b, "p")
    scored = test.join(materialize(scores, "forest_scores"), [*KEY, *b], "left")
    lacks = reduce(and_, [c(f"x_{i}").isNotNull() for i in range(k)])
    return scored.withColumn("pred", F.when(c("y_lo") == c("y_hi"), c("y_lo")).when(lacks, c("p"))).select(*[c(f"`{n}`") for n in names], "pred")

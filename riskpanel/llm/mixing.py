"""Mixing sources to target weights by temperature.

1. A source's share of all tokens p becomes the weight p^alpha / sum p^alpha. The exponent is found by bisection: the largest
   in [0, 1] at which the entropy of the weights reaches ``entropy`` of its maximum, raised if necessary to the smallest at which no source is
   repeated more than ``repeat`` times. The source table is never collected: each step evaluates several exponents in one aggregation.
2. The token budget of a source is its weight times the budget of the mix, rounded down; it is spent in epochs. A source's documents form blocks
   of about ``block_docs`` by a hash; each epoch runs through the blocks in a keyed permutation of its own, and the last stops where the budget ends:
   within a block, documents that the room left can hold are taken in the order of a hash until one does not fit.

Sums run over documents only before blocks; permutations are windows over the blocks of a source, document order is a window within one block.
So the hot source costs blocks, not rows, in a task.

A token is a word ``[^\\x20\\x09-\\x0D]+``. Rows with the same doc_id, source and number of tokens are drawn together, so a hot
repeated row is one unit.

Defined cases: a NULL source counts as the source ''; NULL and empty texts have no tokens and are drawn with their block; a source without tokens is not
drawn; a budget of NULL is the number of tokens there are; an empty table gives no rows. Further columns are carried along by ``mix``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.llm.common import unused
from riskpanel.session import materialize

POINTS = 15  # exponents per step
STEPS = 10  # 16^-10 is below the precision of the rounded exponent


@dataclass(frozen=True)
class MixParams:
    entropy: float = 0.97
    repeat: float = 4.0
    budget: int | None = None
    block_docs: int = 256
    key: str = "mix"


def n_tokens(text: Column) -> Column:
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+", -1), lambda w: w != "")
    return F.when(text.isNull(), 0).otherwise(F.size(words)).cast("long")


def hash60(*parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """``source``, ``doc_id``, ``n_tokens``, ``n_rows``: rows drawn together."""
    return docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("doc_id").cast("long").alias("doc_id"), n_tokens(F.col("text")).alias("n_tokens")
    ).groupBy("source", "doc_id", "n_tokens").agg(F.count("*").alias("n_rows"))


def exponent(sources: DataFrame, params: MixParams) -> float:
    """The exponent for the token totals ``n`` of ``sources``, rounded to 9 digits."""
    head = sources.where("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.min("n").alias("least")).first()
    if not head["k"]:
        return 1.0
    total, least = head["n"], head["least"] / head["n"]
    budget = min(params.budget or total, params.repeat * total)

    def fits(alphas: list[float]) -> list[tuple[bool, bool]]:
        """(entropy reached, repetition within the limit) for each exponent."""
        p = F.col("n") / F.lit(total)
        sums = [(F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p))) for a in alphas]
        row = sources.where("n > 0").agg(*[c.alias(f"c{i}") for i, c in enumerate(x for s in sums for x in s)]).first()
        out = []
        for i, a in enumerate(alphas):
            z, t = row[2 * i], row[2 * i + 1]
            h = math.log(z) - a * t / z
            out.append((h >= params.entropy * math.log(head["k"]) - 1e-12, least ** (a - 1) / z * budget / total <= params.repeat + 1e-9))
        return out

    # Entropy falls and the largest repetition falls as the exponent rises.
    def bisect(which: int, low: float, high: float) -> tuple[float, float]:
        for _ in range(STEPS):
            grid = [low + (high - low) * i / (POINTS + 1) for i in range(POINTS + 2)]
            met = [x[which] for x in fits(grid[1:-1])]
            k = sum(met) if which == 0 else len(met) - sum(met)  # how many lie below the change
            low, high = grid[k], grid[k + 1]
        return low, high

    at = fits([0.0, 1.0])
    spread = 1.0 if at[1][0] else bisect(0, 0.0, 1.0)[0]
    limit = 0.0 if at[0][1] else bisect(1, 0.0, 1.0)[1]
    return round(max(spread, limit), 9)


def budgets(rows: DataFrame, params: MixParams) -> DataFrame:
    """``source``, ``n``, ``weight``, ``tokens`` (its budget), ``whole`` (full epochs), ``rest`` (tokens of the last), ``n_blocks``: a row per source."""
    sources = materialize(rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_rows")).alias("n"), F.count("*").alias("n_units")), "mix_sources")
    alpha = exponent(sources, params)
    total = sources.agg(F.sum("n")).first()[0] or 0
    budget = int(min(params.budget or total, params.repeat * total))
    p = F.pow(F.col("n") / F.lit(max(1, total)), F.lit(alpha))
    z = sources.where("n > 0").agg(F.sum(p)).first()[0] or 1.0
    out = sources.where("n > 0").withColumn("weight", F.round(p / F.lit(z), 12)).withColumn("tokens", F.floor(F.col("weight") * budget).cast("long"))
    whole = F.floor(F.col("tokens") / F.col("n")).cast("long")
    return materialize(out.select(
        "source", "n", "weight", "tokens", whole.alias("whole"), (F.col("tokens") - whole * F.col("n")).alias("rest"),
        F.ceil(F.col("n_units") / params.block_docs).cast("long").alias("n_blocks")), "mix_budgets")


def block_of(params: MixParams) -> Column:
    return hash60(F.lit(params.key), F.col("doc_id")) % F.col("n_blocks")


def blocks(rows: DataFrame, shares: DataFrame, params: MixParams) -> DataFrame:
    """``source``, ``block``, ``epoch``, ``turn`` (its place in the epoch's permutation), ``room``: tokens that may still be taken of it in this
    epoch, NULL if all. Blocks of which nothing is taken in an epoch have no row for it."""
    sized = rows.join(shares, "source").withColumn("block", block_of(params)).groupBy("source", "block").agg(
        F.sum(F.col("n_tokens") * F.col("n_rows")).alias("size"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    last = F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
    epochs = sized.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("epoch"))
    order = Window.partitionBy("source", "epoch").orderBy(hash60(F.lit(params.key), F.col("source"), F.col("epoch"), F.col("block")), "block")
    placed = epochs.withColumn("turn", F.row_number().over(order).cast("long")).withColumn(
        "before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    left = F.col("rest") - F.col("before")
    room = F.when((F.col("epoch") == F.col("whole")) & (left < F.col("size")), left)
    return placed.withColumn("room", room).where("room IS NULL OR room > 0").select("source", "block", "epoch", "turn", "room")


def plan(docs: DataFrame, params: MixParams = MixParams()) -> tuple[DataFrame, DataFrame]:
    """(draws, shares): ``source``, ``doc_id``, ``n_tokens``, ``n_rows``, ``epoch``, ``block``, ``turn`` of every unit drawn, and the budgets."""
    rows = materialize(units(docs), "mix_units")
    shares = budgets(rows, params)
    dealt = materialize(blocks(rows, shares, params), "mix_blocks")
    drawn = rows.join(shares.select("source", "n_blocks"), "source").withColumn("block", block_of(params)).drop("n_blocks").join(dealt, ["source", "block"])
    whole = drawn.where("room IS NULL").drop("room")
    size = F.col("n_tokens") * F.col("n_rows")
    inside = Window.partitionBy("source", "block", "epoch").orderBy(size > F.col("room"), hash60(F.lit(params.key), F.col("epoch"), F.col("doc_id"), F.col("n_tokens")), "doc_id", "n_tokens")
    upto = F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    cut = drawn.where("room IS NOT NULL").withColumn("upto", upto).where("upto <= room").drop("room", "upto")
    return whole.unionByName(cut), shares


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The rows of ``docs`` as often as they are drawn, with their columns: a stage of a pipeline."""
    draws, _ = plan(docs, params)
    source, own_id, n, times, copy = (unused(c, docs) for c in ("_source", "_id", "_n", "_copies", "_copy"))
    copies = draws.groupBy("source", "doc_id", "n_tokens").agg(F.count("*").cast("int").alias(times)).select(
        F.col("source").alias(source), F.col("doc_id").alias(own_id), F.col("n_tokens").alias(n), times)
    on = (F.coalesce(docs["source"].cast("string"), F.lit("")) == F.col(source)) & docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)) & (
        n_tokens(docs["text"]) == F.col(n))
    return docs.join(copies, on).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``source``, ``weight``, ``doc_id``, ``n_tokens``, ``n_rows``, ``epoch``, ``block``, ``turn``: a row per unit and epoch."""
    draws, shares = plan(docs, params)
    return draws.join(shares.select("source", F.round("weight", 9).alias("weight")), "source").select(
        "source", "weight", "doc_id", "n_tokens", "n_rows", "epoch", "block", "turn")


def report_sql(params: MixParams = MixParams()) -> str:
    """The same as ``report`` in SQL; the exponent is bisected by recursion."""
    h = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
    key, budget = params.key, params.budget
    total = "(SELECT sum(n) FROM s)"
    want = f"least({total if budget is None else budget}, {params.repeat} * {total})"
    ent = f"(SELECT ln(z) - a * t / z FROM (SELECT {{a}} AS a, sum(pow(p, {{a}})) AS z, sum(pow(p, {{a}}) * ln(p)) AS t FROM q)) >= {params.entropy} * (SELECT ln(count(*)) FROM q) - 1e-12"
    rep = f"(SELECT pow(min(p), {{a}} - 1) / sum(pow(p, {{a}})) FROM q) * {want} / {total} <= {params.repeat} + 1e-9"
    mid = "(low + high) / 2"
    return f"""
WITH RECURSIVE u AS MATERIALIZED (SELECT coalesce(source, '') AS source, doc_id,
      coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens, count(*) AS n_rows FROM documents GROUP BY 1, 2, 3),
s AS MATERIALIZED (SELECT source, CAST(sum(n_tokens * n_rows) AS BIGINT) AS n, count(*) AS n_units FROM u GROUP BY 1),
q AS MATERIALIZED (SELECT n * 1e0 / {total} AS p FROM s WHERE n > 0),
e(step, low, high) AS (SELECT 0, 0e0, 1e0 UNION ALL
      SELECT step + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
      FROM (SELECT step, low, high, {mid} AS mid, {ent.format(a=mid)} AS ok FROM e WHERE step < 40)),
r(step, low, high) AS (SELECT 0, 0e0, 1e0 UNION ALL
      SELECT step + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
      FROM (SELECT step, low, high, {mid} AS mid, {rep.format(a=mid)} AS ok FROM r WHERE step < 40)),
x AS MATERIALIZED (SELECT round(greatest(
      CASE WHEN {ent.format(a="1e0")} THEN 1e0 ELSE (SELECT low FROM e WHERE step = 40) END,
      CASE WHEN {rep.format(a="0e0")} THEN 0e0 ELSE (SELECT high FROM r WHERE step = 40) END), 9) AS alpha),
w AS (SELECT source, n, n_units, round(pow(n * 1e0 / {total}, alpha) / (SELECT sum(pow(p, alpha)) FROM q, x), 12) AS weight FROM s, x WHERE n > 0),
b AS (SELECT *, CAST(floor(weight * CAST(floor({want}) AS BIGINT)) AS BIGINT) AS tokens FROM w),
c AS MATERIALIZED (SELECT source, weight, CAST(floor(tokens / n) AS BIGINT) AS whole, tokens - CAST(floor(tokens / n) AS BIGINT) * n AS rest,
      CAST(ceil(n_units / {params.block_docs}) AS BIGINT) AS n_blocks FROM b),
d AS MATERIALIZED (SELECT u.*, c.weight, c.whole, c.rest, {h.format(f"'{key}|' || coalesce(CAST(doc_id AS VARCHAR), '')")} % n_blocks AS block FROM u JOIN c USING (source)),
z AS (SELECT source, block, whole, rest, sum(n_tokens * n_rows) AS size FROM d GROUP BY ALL),
y AS (SELECT *, unnest(range(CASE WHEN rest > 0 THEN whole + 1 ELSE whole END)) AS epoch FROM z),
t AS (SELECT *, row_number() OVER o AS turn, sum(size) OVER o - size AS before FROM y WINDOW o AS (PARTITION BY source, epoch
      ORDER BY {h.format(f"'{key}|' || source || '|' || epoch || '|' || block")}, block ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN epoch = whole AND rest - before < size THEN rest - before END AS room FROM t),
g AS (SELECT d.source, d.weight, d.doc_id, d.n_tokens, d.n_rows, f.epoch, d.block, f.turn, f.room, sum(d.n_tokens * d.n_rows) OVER (
      PARTITION BY d.source, d.block, f.epoch ORDER BY coalesce(d.n_tokens * d.n_rows > f.room, false), {h.format(f"'{key}|' || f.epoch || '|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || d.n_tokens")},
      d.doc_id, d.n_tokens ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN f ON d.source = f.source AND d.block = f.block WHERE f.room IS NULL OR f.room > 0)
SELECT source, round(weight, 9) AS weight, doc_id, n_tokens, n_rows, epoch, block, turn FROM g WHERE room IS NULL OR upto <= room
"""

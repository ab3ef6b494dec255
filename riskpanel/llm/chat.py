"""Chat formatting: logged snapshots collapse to maximal conversations, which are rendered.

A service that logs a conversation after each turn leaves snapshots that are prefixes of later ones. Every turn adds a keyed hash of
(position, role, text) to the rolling hash of its conversation; so each prefix has a hash, four sums of 32 bits each with its length. Conversations with the
hash of a proper prefix of another are removed by an anti-join, and of equal conversations the one with the least id stays.

A conversation may be as long as a third of the table: positions and rolling hashes are summed within ranges of ``range_turns`` turn numbers and
then over the ranges, and a rendered conversation comes in parts of ``part_turns`` turns, so no task needs a whole conversation.

Defined cases: rows that repeat (conv_id, turn, role, text) count once; turns are ordered by turn, then role, then text, NULLs last; NULL texts are
rendered empty and NULL roles as ``unknown``, and both differ from '' in comparisons; rows with a NULL conv_id belong to no conversation; the marks of the
template inside a text are broken up by a space, so no text can open or close a turn; an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.session import materialize

SUMS = ("s1", "s2", "s3", "s4")


@dataclass(frozen=True)
class ChatParams:
    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    range_bits: int = 6
    part_turns: int = 64


def turns(conversations: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """``conv_id``, ``range``, ``k`` (position from 1), ``role``, ``text`` and the four hashes of every turn."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text")).distinct()
    last = F.lit(2**62).cast("long")
    rows = rows.withColumn("range", F.coalesce(F.shiftright("turn", params.range_bits), last))
    inside = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    over = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranked = materialize(rows.withColumn("r", F.row_number().over(inside)).drop("turn"), "chat_rows")
    sizes = ranked.groupBy("conv_id", "range").agg(F.count("*").alias("n"))  # a row per range
    sizes = sizes.withColumn("before", F.sum("n").over(over) - F.col("n")).drop("n")
    placed = ranked.join(sizes, ["conv_id", "range"]).withColumn("k", F.col("r") + F.col("before"))
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    digest = F.md5(F.concat(F.col("k").cast("string"), F.lit("|"), told("role"), F.lit("|"), told("text")).cast("binary"))
    piece = lambda i: F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(SUMS[i])
    return placed.withColumn("_digest", digest).select("conv_id", "range", "k", "role", "text", *[piece(i) for i in range(4)])


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``k`` and the rolling hash up to it."""
    inside = Window.partitionBy("conv_id", "range").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv_id", "range").agg(*[F.sum(s).alias(f"{s}_all") for s in SUMS])
    sums = sums.select("conv_id", "range", *[(F.sum(f"{s}_all").over(over) - F.col(f"{s}_all")).alias(f"{s}_before") for s in SUMS])
    local = rows.select("conv_id", "range", "k", *[F.sum(s).over(inside).alias(s) for s in SUMS])
    return local.join(sums, ["conv_id", "range"]).select("conv_id", "k", *[(F.col(s) + F.col(f"{s}_before")).alias(s) for s in SUMS])


def maximal(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``n`` (turns), ``n_equal`` (conversations like it) of the conversations that stay."""
    whole = rows.groupBy("conv_id").agg(F.max("k").alias("n"), *[F.sum(s).alias(s) for s in SUMS])
    distinct = whole.groupBy("n", *SUMS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    ends = whole.select(F.col("conv_id"), F.col("n").alias("end"))
    proper = prefix_hashes(rows).join(ends, "conv_id").where("k < end").select(F.col("k").alias("n"), *SUMS).distinct()
    return distinct.join(proper, ["n", *SUMS], "left_anti").select("conv_id", "n", "n_equal")


def rendered(role: Column, text: Column, params: ChatParams) -> Column:
    def calm(c: Column) -> Column:
        for mark in (params.open, params.close):
            c = F.replace(c, F.lit(mark), F.lit(f"{mark[:1]} {mark[1:]}"))
        return c

    return F.concat(F.lit(params.open), calm(F.coalesce(role, F.lit("unknown"))), F.lit("\n"), calm(F.coalesce(text, F.lit(""))), F.lit(f"{params.close}\n"))


def render(conversations: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """``conv_id``, ``part`` (from 0), ``n_turns`` (of the part), ``n_equal``, ``text``: the maximal conversations. Runs jobs when called."""
    rows = materialize(turns(conversations, params), "chat_turns")
    kept = materialize(maximal(rows), "chat_kept")
    part = F.floor((F.col("k") - 1) / params.part_turns).cast("long")
    return (
        rows.join(kept.select("conv_id", "n_equal"), "conv_id").withColumn("part", part).withColumn("line", rendered(F.col("role"), F.col("text"), params))
        .groupBy("conv_id", "part").agg(F.count("*").alias("n_turns"), F.max("n_equal").alias("n_equal"), F.array_sort(F.collect_list(F.struct("k", "line"))).alias("lines"))
        .select("conv_id", "part", "n_turns", "n_equal", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))
    )


def render_sql(params: ChatParams = ChatParams()) -> str:
    def calm(c: str) -> str:
        for mark in (params.open, params.close):
            c = f"replace({c}, '{mark}', '{mark[:1]} {mark[1:]}')"
        return c

    told = lambda c: f"coalesce('=' || {c}, '-')"
    return f"""
WITH d AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
t AS MATERIALIZED (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS k FROM d),
h AS MATERIALIZED (SELECT *, string_agg(md5({told('role')} || '|' || {told('text')}), ',') OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM t),
w AS MATERIALIZED (SELECT conv_id, max(k) AS n, arg_max(prefix, k) AS prefix FROM h GROUP BY 1),
u AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_equal FROM w GROUP BY 1),
p AS (SELECT DISTINCT h.prefix FROM h JOIN w USING (conv_id) WHERE h.k < w.n),
m AS (SELECT * FROM u WHERE prefix NOT IN (SELECT prefix FROM p))
SELECT conv_id, CAST(floor((k - 1) / {params.part_turns}) AS BIGINT) AS part, count(*) AS n_turns, max(n_equal) AS n_equal,
  string_agg('{params.open}' || {calm("coalesce(role, 'unknown')")} || chr(10) || {calm("coalesce(text, '')")} || '{params.close}' || chr(10), '' ORDER BY k) AS text
FROM t JOIN m USING (conv_id) GROUP BY 1, 2
"""

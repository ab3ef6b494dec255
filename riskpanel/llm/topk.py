"""Exact top-k search by distributed histogram selection.

Every query meets every candidate, in blocks, once per round. A round counts each query's scores in the bins of its current
interval; the summed histogram shows in which bin the k-th best score lies, and that bin is the next interval. When bins are one
wide the k-th value is known, and a last pass keeps what lies above it and, of the ties, those with the smallest ids.

Components become ``floor(256 * x)`` and scores are their integer inner products, computed exactly: in floating point below 2^53, in 64-bit integers
below 2^60, else in integers of any length.

Queries are taken in blocks of at most ``block`` vectors, so what is sent to the executors at a time has a fixed size; candidates are
never moved. A task reports per query only its highest bins that together hold as many scores as are still sought: lower ones
cannot hold the k-th value.

Defined cases: vectors that are NULL or hold NULL or non-finite components (also after the factor 256), and rows without an id take no part; a score among
the k best that no long can hold stops the search with an error; vectors of different lengths are not compared; a query with fewer than k candidates gets all; a query row repeated with the
same vector counts once; a repeated candidate row is a candidate each time; a candidate with the query's id is the query's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 512
PART = 512  # candidates scored at a time


def usable(vector: Column) -> Column:
    """Whether all components are finite."""
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**1015)), F.lit(False))


def whole_numbers(x: np.ndarray, kind: type) -> np.ndarray:
    """``floor(256 * x)`` as numbers of the kind that scores are computed in."""
    floors = np.floor(256.0 * x)
    return np.frompyfunc(int, 1, 1)(floors).astype(object) if kind is object else floors.astype(kind)


@dataclass
class QueryBlock:
    """Queries of one length: row ``i`` of ``matrix`` is query number ``number[i]`` of the block."""

    number: np.ndarray
    ids: np.ndarray
    matrix: np.ndarray
    low: np.ndarray  # the interval is [low, low + BINS * width)
    need: np.ndarray  # how many scores of the interval are still sought


def scored(batches: Iterator[pa.RecordBatch], blocks: dict[int, QueryBlock]) -> Iterator[tuple[QueryBlock, np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, candidate ids, scores as a matrix query x candidate, which of them are not the query's own), for candidates of the
    queries' length."""
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        lengths = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        for dim, block in blocks.items():
            rows = np.flatnonzero(lengths == dim)
            for at in range(0, len(rows), PART):
                part = rows[at:at + PART]
                matrix = whole_numbers(flat[starts[part][:, None] + np.arange(dim)[None, :]], block.matrix.dtype.type if block.matrix.dtype != object else object)
                yield block, ids[part], block.matrix @ matrix.T, block.ids[:, None] != ids[part][None, :]


def histograms(candidates: DataFrame, blocks: dict[int, QueryBlock], width: int) -> DataFrame:
    """``q``, ``bin``, ``n``: the summed histogram of every query over its interval, as far down as it can matter."""
    shared = candidates.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {d: np.zeros((len(b.ids), BINS), np.int64) for d, b in shared.value.items()}
        for block, _, s, other in scored(batches, shared.value):
            bins = (s - block.low[:, None]) // width
            hit = other & (bins >= 0).astype(bool) & (bins < BINS).astype(bool)
            row = np.broadcast_to(np.arange(len(block.ids))[:, None], s.shape)[hit]
            total = counts[block.matrix.shape[1]]
            total += np.bincount(row * BINS + bins[hit].astype(np.int64), minlength=total.size).reshape(total.shape)
        for dim, total in counts.items():
            block = shared.value[dim]
            above = total[:, ::-1].cumsum(axis=1)[:, ::-1] - total  # scores in higher bins
            q, b = np.nonzero((total > 0) & (above < block.need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(block.number[q]), pa.array(b.astype(np.int64)), pa.array(total[q, b])], ["q", "bin", "n"])

    return candidates.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def select_bins(histogram: DataFrame, need: DataFrame) -> DataFrame:
    """``q``, ``bin`` that holds the sought score, ``above``: how many scores lie in higher bins. At most BINS rows a query."""
    down = Window.partitionBy("q").orderBy(F.col("bin").desc())
    return (
        histogram.join(need, "q").withColumn("upto", F.sum("n").over(down)).where("upto >= need")
        .groupBy("q").agg(F.max("bin").alias("bin"), F.max_by(F.col("upto") - F.col("n"), "bin").alias("above"))
    )


def best(candidates: DataFrame, blocks: dict[int, QueryBlock], k: int) -> DataFrame:
    """All scores above each query's k-th value ``low``, and per task the ``need`` smallest ids among the ties; then the first k."""
    shared = candidates.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, dict[int, np.ndarray]] = {d: {} for d in shared.value}
        for block, ids, s, other in scored(batches, shared.value):
            q, c = np.nonzero(other & (s > block.low[:, None]).astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(block.number[q]), pa.array(ids[c]), pa.array(s[q, c].astype(np.int64))],
                                             ["query_id", "q", "vec_id", "score"])
            q, c = np.nonzero(other & (s == block.low[:, None]).astype(bool))
            order = np.lexsort((ids[c], q))
            kept = ties[block.matrix.shape[1]]
            cuts = np.flatnonzero(np.diff(q[order])) + 1
            for some in np.split(order, cuts) if len(order) else ():
                i = int(q[some[0]])
                found = np.concatenate([kept.get(i, np.zeros(0, np.int64)), ids[c[some[:block.need[i]]]]])
                kept[i] = np.sort(found)[:block.need[i]]
        for dim, kept in ties.items():
            block = shared.value[dim]
            for i, found in kept.items():
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block.ids[i])), pa.array(np.full(n, block.number[i])), pa.array(found),
                                                  pa.array(np.full(n, int(block.low[i])))], ["query_id", "q", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    return (
        candidates.mapInArrow(run, "query_id long, q long, vec_id long, score long")
        .withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def search(vectors: DataFrame, is_query: Column, k: int = 5, block: int = 8192, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: the k best of all rows for each row that ``is_query`` marks.

    Runs the rounds of every block when called; the last pass is lazy.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector_column)))
    candidates = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    chosen = rows.where(is_query).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).distinct()
    head = candidates.agg(F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    bound = (int(256 * (head[0] or 0.0)) + 1) ** 2 * (head[1] or 0)  # no score is larger
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**60 else object
    n_blocks = max(1, -(-chosen.count() // block))
    widths = [1]
    while widths[-1] * BINS < 2 * bound + 1:
        widths.append(widths[-1] * BINS)
    parts = []
    for number in range(n_blocks):
        # One block of the stated query set: at most about ``block`` vectors.
        own = sorted((tuple(r) for r in chosen.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == number).collect()), key=lambda r: (r[0], r[1]))
        by_dim: dict[int, list[int]] = {}
        for i, (_, v) in enumerate(own):
            by_dim.setdefault(len(v), []).append(i)
        blocks = {
            d: QueryBlock(np.array(i, np.int64), np.array([own[x][0] for x in i], np.int64),
                          whole_numbers(np.array([own[x][1] for x in i], np.float64).reshape(len(i), d), kind),
                          np.full(len(i), -bound, kind), np.full(len(i), k))
            for d, i in by_dim.items()
        }
        everything = np.zeros(len(own), bool)  # queries with fewer than k candidates
        for width in reversed(widths):
            need = spark.createDataFrame([(int(q), int(n)) for b in blocks.values() for q, n in zip(b.number, b.need)], "q long, need long")
            found = {r["q"]: (r["bin"], r["above"]) for r in select_bins(histograms(candidates, blocks, width), need).collect()}
            for b in blocks.values():
                for i, q in enumerate(b.number):
                    if int(q) in found and not everything[q]:
                        at, above = found[int(q)]
                        b.low[i] += at * width
                        b.need[i] -= above
                    else:
                        everything[q], b.low[i] = True, -bound - 1
        parts.append(best(candidates, blocks, k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out

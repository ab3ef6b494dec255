"""Near-duplicates: many universal hash minima with banding, verification on signatures and full sets, connected components.

1. Each text becomes the set of its distinct word shingles, held as 64-bit hashes; texts with equal sets are one node from here on,
   so exact copies cost one row each. The minima of ``hashes`` multiply-shift functions form the signature.
2. Equal bands of the signature make buckets. Nodes of a bucket are compared with its least node, the pivot. Buckets with the same pivot are
   one group, so a pair that meets in many bands is compared once.
3. Pairs of a group of which neither is known to be linked to the pivot, or one is not, are compared too: the group is dealt into
   blocks of ``block`` nodes, and pairs of blocks go to tasks. So every pair that shares a band is either compared, or linked through the pivot.
   No pair is written unless it is a link, and no task holds more than two blocks.
4. A comparison drops a pair whose signatures agree in far fewer places than the similarity asks (6 standard deviations), and
   computes the exact similarity on the full sets for the rest.
5. Components of the links by large-star and small-star.

A pair at the threshold shares no band with probability (1 - s^rows)^bands: 6e-11 at 0.85 and 5e-8 at 0.8 with the default 32 bands of 4.

Defined cases: NULL, empty and word-less texts have no shingles and are linked with nothing; a text with fewer words than a shingle has
one shingle, the whole; rows with the same ``doc_id`` count as one document; a NULL ``doc_id`` is linked with nothing, has no component
and is kept. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.common import WordHashes, mix64, slices, unused
from riskpanel.llm.components import components
from riskpanel.session import materialize


WORDS_KEPT = 100_000  # words whose hashes a task remembers


@dataclass(frozen=True)
class NearParams:
    words: int = 5
    percent: int = 80  # linked if 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 4
    block: int = 128
    seed: int = 7

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreement(self) -> float:
        s = self.percent / 100
        return s - 6 * math.sqrt(s * (1 - s) / self.hashes)


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles, A-Z in lower case."""
    found = text.encode().lower().split() if text else []  # of bytes: ASCII letters and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    h = hashes.of(found)
    if len(h) < words:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), len(h))], np.uint64)
    n = len(h) - words + 1
    x = np.zeros(n, np.uint64)
    for k in range(words):
        x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(x)


class Minima:
    def __init__(self, params: NearParams):
        random = np.random.default_rng(params.seed)
        self.width = 4 * params.rows
        self.a = random.integers(0, 2**63, params.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = random.integers(0, 2**63, params.hashes, dtype=np.uint64)

    def signature(self, x: np.ndarray) -> np.ndarray:
        """The upper halves of the minima of a * x + b modulo 2^64."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max)
        for at in range(0, len(x), 512):
            np.minimum(least, (self.a[:, None] * x[None, at:at + 512] + self.b[:, None]).min(axis=1), out=least)
        return (least >> np.uint64(32)).astype("<u4")

    def bands(self, x: np.ndarray) -> list[int]:
        """A key for each band of the signature."""
        packed = self.signature(x).tobytes()
        return [xxhash.xxh64_intdigest(packed[i:i + self.width], seed=i) - 2**63 for i in range(0, len(packed), self.width)]


def sketch(docs: DataFrame, params: NearParams) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``h1``, ``h2`` (hash of the set, NULL if empty), ``bands`` (a key each). Signatures are not kept: only texts that meet
    another in a band need theirs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minima = WordHashes(WORDS_KEPT), Minima(params)
        for batch in slices(batches, "text"):
            n, h1, h2, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                x = shingles(text, params.words, hashes)
                n.append(len(x))
                key = xxhash.xxh128_digest(x.tobytes()) if len(x) else None
                h1.append(int.from_bytes(key[:8], "big", signed=True) if key else None)
                h2.append(int.from_bytes(key[8:], "big", signed=True) if key else None)
                bands.append(minima.bands(x) if key else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                                              pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "h1", "h2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def full_sets(docs: DataFrame, params: NearParams) -> DataFrame:
    """``node``, ``h1``, ``h2``, ``signature``, ``members`` (the shingle hashes, packed) of the rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minima = WordHashes(WORDS_KEPT), Minima(params)
        for batch in slices(batches, "text"):
            sets = [shingles(t, params.words, hashes) for t in batch.column("text").to_pylist()]
            packed = [x.astype("<u8").tobytes() for x in sets]
            keys = [xxhash.xxh128_digest(x) for x in packed]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([int.from_bytes(k[:8], "big", signed=True) for k in keys], pa.int64()),
                pa.array([int.from_bytes(k[8:], "big", signed=True) for k in keys], pa.int64()),
                pa.array([minima.signature(x).tobytes() for x in sets], pa.binary()), pa.array(packed, pa.binary())], ["node", "h1", "h2", "signature", "members"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "node long, h1 long, h2 long, signature binary, members binary")


class Compared:
    """Rows of one task: ids, signatures and sets, and the exact test."""

    def __init__(self, table: pa.Table, params: NearParams):
        self.params = params
        self.node = table.column("node").to_numpy()
        self.signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(len(self.node), params.hashes)
        self.members = [np.frombuffer(x, "<u8") for x in table.column("members").to_pylist()]
        self.size = np.array([len(x) for x in self.members], np.int64)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` (row numbers) are linked with row ``i``."""
        percent = self.params.percent
        a, b = np.minimum(self.size[i], self.size[others]), np.maximum(self.size[i], self.size[others])
        others = others[100 * a >= percent * b]
        agree = (self.signature[others] == self.signature[i]).mean(axis=1)
        others = others[agree >= self.params.least_agreement]
        out = []
        for j in others:
            common = len(np.intersect1d(self.members[i], self.members[j], assume_unique=True))
            if 100 * common >= percent * (self.size[i] + self.size[j] - common):
                out.append(j)
        return np.array(out, np.int64)


def links(docs: DataFrame, nodes: DataFrame, params: NearParams) -> DataFrame:
    """``u``, ``v``: enough links between nodes to connect all that are linked through pairs sharing a band."""
    bands = nodes.select("node", F.explode("bands").alias("key"))
    pivots = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
    met = materialize(bands.join(pivots, "key").where("node <> pivot").select("pivot", "node").distinct(), "near_met")

    # Only texts that met another are read again; their sets are computed anew instead of stored.
    involved = met.select("node").unionAll(met.select(F.col("pivot").alias("node"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    ids = involved.withColumnRenamed("node", "doc_id")
    ids = F.broadcast(ids) if involved.count() <= 1_000_000 else ids  # 8 bytes each; beyond that Spark joins by shuffling
    sets = full_sets(texts.join(ids, "doc_id", "left_semi"), params)
    sets = sets.join(nodes.select("node", "h1", "h2"), ["node", "h1", "h2"]).dropDuplicates(["node", "h1", "h2"]).select("node", "signature", "members")
    sets = materialize(sets, "near_sets")

    sizes = met.groupBy("pivot").agg(F.count("*").alias("n"))
    blocks_of = F.ceil(F.col("n") / params.block).cast("long")
    placed = met.join(sizes, "pivot").withColumn("blocks", blocks_of).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")))

    # Pivot against each block of its group.
    rows = placed.select("pivot", "b", "node", F.lit(False).alias("is_pivot")).unionAll(
        sizes.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), blocks_of - 1)).alias("b"), F.col("pivot").alias("node"), F.lit(True).alias("is_pivot")))
    rows = rows.join(sets, "node")

    def against_pivot(table: pa.Table) -> pa.Table:
        rows = Compared(table, params)
        is_pivot = table.column("is_pivot").to_numpy(zero_copy_only=False)
        others = np.flatnonzero(~is_pivot)
        hit: set[int] = set()
        for p in np.flatnonzero(is_pivot):  # more than one if rows with the pivot's doc_id have different texts
            hit.update(rows.node[rows.linked(int(p), others)].tolist())
        node = np.unique(rows.node[others])
        pivot = np.full(len(node), table.column("pivot").to_numpy()[0])
        return pa.table({"pivot": pivot, "node": node, "hit": pa.array([int(x) in hit for x in node], pa.bool_())})

    first = materialize(rows.groupBy("pivot", "b").applyInArrow(against_pivot, "pivot long, node long, hit boolean"), "near_first")

    # Within a group, nodes not linked to the pivot (strays) against all others, block against block: strays' blocks come first.
    counted = first.groupBy("pivot").agg(F.count("*").alias("n"), F.count_if(~F.col("hit")).alias("strays")).where("n > 1 AND strays > 0")
    stray_blocks = F.ceil(F.col("strays") / params.block).cast("long")
    hit_blocks = F.ceil((F.col("n") - F.col("strays")) / params.block).cast("long")
    dealt = first.join(counted, "pivot").select(
        "pivot", "node", "hit", stray_blocks.alias("s"), (stray_blocks + hit_blocks).alias("t"),
        F.when(F.col("hit"), stray_blocks + F.pmod(F.xxhash64("node"), F.greatest(hit_blocks, F.lit(1).cast("long"))))
        .otherwise(F.pmod(F.xxhash64("node"), stray_blocks)).alias("b"))
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    pairs = F.when(  # (i, j) with i <= j and i a block of strays
        F.col("hit"), F.transform(F.sequence(zero, F.col("s") - one), lambda i: F.struct(i.alias("i"), F.col("b").alias("j")))
    ).otherwise(F.concat(
        F.transform(F.sequence(F.col("b"), F.col("t") - one), lambda j: F.struct(F.col("b").alias("i"), j.alias("j"))),
        F.when(F.col("b") > 0, F.transform(F.sequence(zero, F.col("b") - one), lambda i: F.struct(i.alias("i"), F.col("b").alias("j"))))
        .otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>"))))
    spread = dealt.select("pivot", "node", "b", F.inline(pairs)).join(sets, "node")

    def among_strays(table: pa.Table) -> pa.Table:
        rows = Compared(table, params)
        b, i = table.column("b").to_numpy(), table.column("i").to_numpy()[0]
        j = table.column("j").to_numpy()[0]
        left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
        parent = np.arange(len(rows.node))  # links already known within this task need no second test
        u, v = [], []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x in left:
            mine = root(int(x))
            others = np.array([y for y in right if (i != j or y > x) and root(int(y)) != mine], np.int64)
            for y in rows.linked(int(x), others) if len(others) else ():
                a, c = root(int(x)), root(int(y))
                if a != c:
                    parent[a] = c
                    u.append(int(rows.node[x]))
                    v.append(int(rows.node[y]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    rest = spread.groupBy("pivot", "i", "j").applyInArrow(among_strays, "u long, v long")
    return first.where("hit").select(F.col("pivot").alias("u"), F.col("node").alias("v")).unionAll(rest)


def near_duplicates(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``, one row per row of ``docs``. Runs jobs when called."""
    sketched = materialize(sketch(docs, params), "near_sketch")
    own = sketched.where("h1 IS NOT NULL AND doc_id IS NOT NULL")
    nodes = own.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "bands")).alias("least"))  # equal sets, which have equal bands
    nodes = materialize(nodes.select(F.col("least.doc_id").alias("node"), "h1", "h2", F.col("least.bands").alias("bands")), "near_nodes")
    found = links(docs, nodes, params)
    nodes = nodes.select("node", "h1", "h2")
    # A doc_id whose rows have different texts is one document: its nodes are linked.
    same = own.select("doc_id", "h1", "h2").distinct().join(nodes, ["h1", "h2"]).where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    several = own.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("z")).where("a <> z").select("doc_id")
    found = found.unionAll(same.join(several, F.col("u") == F.col("doc_id"), "left_semi"))
    labels = components(found.select("u", "v"), "near_components")
    named = nodes.join(labels, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """The rows of ``docs`` whose document stays, one document of each component, with all columns: a stage of a pipeline. A document
    that goes is named by its id, which is all that is joined back."""
    gone_id = unused("gone_id", docs)
    gone = near_duplicates(docs, params).where("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(gone_id), "left_anti")

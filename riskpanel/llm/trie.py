"""Prefix trie of conversations: how many share each sequence of first turns, and what storing the shared turns once would save.

1. Dictionary: each distinct (role, text) gets an integer, in their order. Very frequent turns (more than one row in a thousand) are joined by
   broadcast, as there are under a thousand of them, the rest by shuffling.
2. Conversations become sequences of turn ids, cut into segments of ``segment`` turns. A hash of the segments before it names the trie node
   that a segment starts from, its root. Equal segments of a root are one row with a count from here on.
3. Segments are sorted and dealt out by ranges (shards). A task cuts its range into blocks of at most ``block`` turns, and builds a ternary search tree
   over the segments of a root in a block, inserting medians first, so that it is balanced. An iterative traversal adds up members, leaves and savings.
4. A node may continue in the next block only if it is on the path of a block's first or last segment, or a root. Such boundary nodes are summed
   over blocks by key; their own leaf and saving are decided after that, and go to themselves and to the boundary nodes above them.
5. Segments are taken from the deepest up, as a node at the end of a full segment gets what is below it from the segments that start there. Only segments
   of which several different conversations go through the root need that: in all others the path has no branches, and its sums are running sums.
6. Ids of the conversations that end in a node are sorted over all tasks, joined in pieces, and the pieces are hashed in order as they stream by.

No task holds a conversation, a node's members or its children whole. There are as many rounds as segments lie above the deepest turn at which two
different conversations still agree.

Defined cases: turns are in ascending order, NULL first, and equal turn numbers in the order of (role, text); repeated rows are turns of their own; NULL
roles and texts become ''; rows with a NULL ``conv_id`` belong to no conversation; a conversation without turns is a member of the root; an empty table has no
nodes. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.llm.order import in_order, ranked
from riskpanel.session import materialize

SUMS = ("s1", "s2", "s3", "s4")
START = hashlib.md5(b"start").hexdigest()
NO_END = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class TrieParams:
    segment: int = 1024  # turns
    block: int = 200_000  # turns
    piece: int = 4096  # ids joined before they are hashed
    fan: int = 100  # conversations that share a base
    most_shared: int = 6  # first turns taken from the base: fewer than this


def turn_ids(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (``conv_id``, ``turn``, ``id``, ``points``: code points of the text) and the dictionary (``id``, ``role``, ``text``)."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    distinct = rows.groupBy("role", "text").agg(F.count("*").alias("n"))
    entries = in_order(distinct, [F.col("role").asc(), F.col("text").asc()]).select(
        F.monotonically_increasing_id().alias("id"), "role", "text", "n")
    entries = materialize(entries, "trie_dictionary")
    total = entries.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(entries.where(F.col("n") * 1000 > total).select(F.col("id").alias("hot_id"), "role", "text"))  # under 1000 rows
    marked = rows.join(hot, ["role", "text"], "left")
    rare = marked.where("hot_id IS NULL").join(entries.where(F.col("n") * 1000 <= total).select("id", "role", "text"), ["role", "text"])
    points = F.char_length("text").cast("long").alias("points")
    coded = rare.select("conv_id", "turn", "id", points).unionAll(marked.where("hot_id IS NOT NULL").select("conv_id", "turn", F.col("hot_id").alias("id"), points))
    return coded, entries.select("id", "role", "text")


def rebuilt(coded: DataFrame, params: TrieParams) -> tuple[DataFrame, DataFrame]:
    """Rows (``conv_id``, ``k``: place from 0, ``id``, ``points``) of the conversations after each took its first turns from its base, and all ``conv_id``."""
    placed = materialize(ranked(coded, "conv_id", [F.col("turn").asc_nulls_first(), F.col("id").asc()], "trie_sorted").select("conv_id", "idx", "n", "id", "points"), "trie_turns")
    base = F.col("conv_id") - F.col("conv_id") % params.fan
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % params.most_shared
    every = placed.where("idx = 0").select("conv_id", base.alias("base"), shared.alias("h"))
    heads = placed.where(F.col("conv_id") % params.fan == 0).where(F.col("idx") < params.most_shared - 1).select(F.col("conv_id").alias("base"), "idx", "id", "points")
    taken = every.join(heads, "base").where("idx < h").select("conv_id", F.col("idx").alias("k"), "id", "points")
    sizes = placed.where("idx = 0").select(F.col("conv_id").alias("base"), "n").where(F.col("base") % params.fan == 0)
    starts = every.join(sizes, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("m"))
    own = placed.select("conv_id", "idx", "id", "points").join(starts, "conv_id").where("idx >= h")
    own = own.select("conv_id", (F.col("idx") - F.col("h") + F.col("m")).alias("k"), "id", "points")
    return taken.unionAll(own), every.select("conv_id")


def segments(turns: DataFrame, every: DataFrame, params: TrieParams) -> DataFrame:
    """A row for each segment of each conversation: ``conv_id``, ``seg``, ``root``, ``next_root`` (NULL at the end), ``ids``, ``points``, ``node``
    (its last node)."""
    cut = turns.withColumn("seg", F.floor(F.col("k") / params.segment).cast("long")).groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list(F.struct("k", "id", "points"))).alias("t"))
    cut = cut.select("conv_id", "seg", F.col("t.id").alias("ids"), F.col("t.points").alias("points"))
    none = F.array().cast("array<bigint>")
    bare = every.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("seg"), none.alias("ids"), none.alias("points"))
    cut = cut.unionAll(bare)
    digest = F.md5(F.concat_ws(",", F.col("seg").cast("string"), F.col("ids").cast("array<string>")).cast("binary"))
    piece = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(SUMS[i])
    over = Window.partitionBy("conv_id").orderBy("seg")
    before = [(F.sum(s).over(over) - F.col(s)).alias(f"{s}_before") for s in SUMS]
    rows = cut.select("*", *[piece(i) for i in range(4)]).select("conv_id", "seg", "ids", "points", *before)
    named = F.when(F.col("seg") == 0, F.lit(START)).otherwise(F.md5(F.concat_ws(",", "seg", *[f"{s}_before" for s in SUMS]).cast("binary")))
    rows = rows.withColumn("root", named)
    rows = rows.withColumn("next_root", F.lead("root").over(over))
    return rows.withColumn("node", F.md5(F.concat_ws(",", "root", F.col("ids").cast("array<string>")).cast("binary"))).select(
        "conv_id", "seg", "root", "next_root", "ids", "points", "node")


class Block:
    """Segments of one range, and the ternary search trees over them."""

    def __init__(self, size: int):
        self.size = size
        self.rows: list[dict] = []
        self.turns = 0

    def add(self, row: dict) -> bool:
        """False if the row has to go to the next block."""
        if self.rows and self.turns + len(row["ids"]) > self.size:
            return False
        self.rows.append(row)
        self.turns += len(row["ids"]) + 1
        return True

    @staticmethod
    def _medians(n: int) -> Iterator[int]:
        spans = [(0, n)]
        while spans:
            a, b = spans.pop()
            if a < b:
                m = (a + b) // 2
                yield m
                spans += [(m + 1, b), (a, m)]

    def nodes(self, name: int) -> Iterator[tuple]:
        """(block, boundary, key, parent key, depth in the segment, conv_id, parent conv_id, members, ended members, children, leaves, saved, points).
        Of a boundary node leaves and savings are those of the other nodes below it, and children those that are no boundary nodes."""
        start = 0
        while start < len(self.rows):
            end = start
            while end < len(self.rows) and self.rows[end]["root"] == self.rows[start]["root"]:
                end += 1
            yield from self._tree(name, start, end)
            start = end

    def _tree(self, name: int, start: int, end: int) -> Iterator[tuple]:
        rows = self.rows[start:end]
        edge = [rows[0]["ids"] if start == 0 else None, rows[-1]["ids"] if end == len(self.rows) else None]
        turn, low, high, equal = [0], [-1], [-1], [-1]  # 0 is the root; ``equal`` leads to the tree of the next turns
        up, points, deep = [-1], [0], [0]
        count, ended, least = [0], [0], [None]
        below: dict[int, dict] = {}

        def new(t: int, parent: int, p: int) -> int:
            for column, value in ((turn, t), (low, -1), (high, -1), (equal, -1), (up, parent), (points, p), (deep, deep[parent] + 1), (count, 0), (ended, 0), (least, None)):
                column.append(value)
            return len(turn) - 1

        for m in self._medians(len(rows)):
            row, at = rows[m], 0
            for t, p in zip(row["ids"], row["points"]):
                node = equal[at]
                if node < 0:
                    node = equal[at] = new(t, at, p)
                else:
                    while turn[node] != t:
                        side = low if t < turn[node] else high
                        if side[node] < 0:
                            side[node] = new(t, at, p)
                        node = side[node]
                at = node
            count[at] += row["n"]
            ended[at] += row["n_ended"]
            least[at] = row["conv"] if least[at] is None else min(least[at], row["conv"])
            if row["below_leaves"] is not None:
                below[at] = row
        if rows[0]["root_conv"] is not None:
            least[0] = rows[0]["root_conv"]
        # Parents come before their children in the order of creation, so one backward pass is a post-order traversal without recursion.
        n = len(turn)
        edge_nodes = {0}
        for ids in edge:
            at = 0
            for t in ids or ():
                node = equal[at]
                while turn[node] != t:
                    node = low[node] if t < turn[node] else high[node]
                edge_nodes.add(node)
                at = node
        children, leaves, saved = [0] * n, [0] * n, [0] * n
        for at in range(n - 1, -1, -1):
            if at in below:  # what starts at the end of a full segment
                children[at] += below[at]["below_children"]
                leaves[at] += below[at]["below_leaves"]
                saved[at] += below[at]["below_saved"]
            if at not in edge_nodes:
                leaves[at] += not children[at]
                saved[at] += (count[at] - 1) * points[at]
            parent = up[at]
            if parent >= 0:
                count[parent] += count[at]
                least[parent] = least[at] if least[parent] is None else min(least[parent], least[at])
                if at not in edge_nodes:
                    children[parent] += 1
                    leaves[parent] += leaves[at]
                    saved[parent] += saved[at]
        root = rows[0]["root"]
        hashes, keys = [hashlib.md5(root.encode())], [root]
        keys[0] = hashes[0].hexdigest()
        for at in range(n):
            if at:
                h = hashes[up[at]].copy()
                h.update(b",%d" % turn[at])
                hashes.append(h)
                keys.append(h.hexdigest())
            parent = up[at]
            yield (name, at in edge_nodes, keys[at], keys[parent] if at else None, deep[at], least[at], least[parent] if at else None, count[at], ended[at],
                   children[at], leaves[at], saved[at], points[at])


NODE = ("block long, boundary boolean, key string, parent string, deep long, conv_id long, parent_conv_id long, n_convs long, n_ended long, n_children long, "
        "n_leaves long, saved_tokens long, points long")


def block_nodes(rows: DataFrame, params: TrieParams) -> DataFrame:
    """Nodes of each block of the sorted segments ``rows``."""
    names = NODE.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", ")
    schema = pa.schema([(n, pa.string() if n in ("key", "parent") else pa.bool_() if n == "boundary" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0

        def out(block: Block, part: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            pending = []
            for node in block.nodes(part << 32 | made):
                pending.append(node)
                if len(pending) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pending), schema)], schema=schema)
                    pending = []
            if pending:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pending), schema)], schema=schema)
            made += 1

        block, part = Block(params.block), 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                for row in batch.slice(at, 256).to_pylist():
                    part = row["part"]
                    if not block.add(row):
                        yield from out(block, part)
                        block = Block(params.block)
                        block.add(row)
        if block.rows:
            yield from out(block, part)

    ordered = rows.repartitionByRange(F.col("root").asc(), F.col("ids").asc()).sortWithinPartitions("root", "ids").withColumn("part", F.spark_partition_id())
    columns = ("part", "root", "root_conv", "ids", "points", "n", "n_ended", "conv", "below_children", "below_leaves", "below_saved")
    return ordered.select(*columns).mapInArrow(run, NODE)


def merged(nodes: DataFrame, params: TrieParams) -> tuple[DataFrame, DataFrame]:
    """All nodes, with boundary nodes summed over blocks; and the roots among them. ``nodes`` are those of :func:`block_nodes`, stored."""
    edge = nodes.where("boundary")
    sums = edge.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("deep").alias("deep"), F.min("conv_id").alias("conv_id"), F.max("points").alias("points"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_ended", "n_children", "n_leaves", "saved_tokens")])
    sums = materialize(sums, "trie_boundary")
    kids = sums.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("kids"))
    sums = sums.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    # A boundary node's own leaf and saving; a root is no node of its own unless it is the root of all (``points`` is 0, and it saves nothing).
    sums = sums.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("own", (F.col("n_convs") - 1) * F.col("points"))
    sums = materialize(sums, "trie_boundary")
    # To all boundary nodes above, along paths of at most ``segment`` nodes: by doubling, the ancestors 2^i levels up get the sums of 2^i levels.
    total = sums.select("key", F.col("parent").alias("jump"), (F.col("leaf") + F.col("n_leaves")).alias("l"), (F.col("own") + F.col("saved_tokens")).alias("o"))
    deepest = sums.agg(F.max("deep")).first()[0] or 0
    step = 1
    while step <= deepest:
        # total(v) over levels [0, step) plus total of the descendants exactly ``step`` levels below over [0, step)
        add = total.where("jump IS NOT NULL").groupBy(F.col("jump").alias("key")).agg(F.sum("l").alias("dl"), F.sum("o").alias("do"))
        above = total.select(F.col("key").alias("jump"), F.col("jump").alias("further"))
        total = total.join(above, "jump", "left").join(add, "key", "left").select(
            "key", F.col("further").alias("jump"), (F.col("l") + F.coalesce("dl", F.lit(0))).alias("l"), (F.col("o") + F.coalesce("do", F.lit(0))).alias("o"))
        total = materialize(total, "trie_boundary_sums")
        step *= 2
    whole = sums.join(total.select("key", "l", "o"), "key").select(
        "key", "parent", "deep", "conv_id", "n_convs", "n_ended", "n_children", F.col("l").alias("n_leaves"), F.col("o").alias("saved_tokens"))
    parents = sums.select(F.col("key").alias("parent"), F.col("conv_id").alias("named"))
    whole = materialize(whole.join(parents, "parent", "left").withColumnRenamed("named", "parent_conv_id"), "trie_boundary_nodes")
    # Nodes whose parent is a boundary node learn its conversation, by block so that no parent's children meet in one task.
    inner = nodes.where("NOT boundary")
    here = edge.select("block", "key").join(whole.select("key", F.col("conv_id").alias("named")), "key").select("block", F.col("key").alias("parent"), "named")
    inner = inner.join(here, ["block", "parent"], "left").withColumn("parent_conv_id", F.coalesce("named", "parent_conv_id"))
    columns = ("key", "deep", "conv_id", "parent_conv_id", "n_convs", "n_ended", "n_children", "n_leaves", "saved_tokens")
    return inner.select(*columns).unionAll(whole.where("parent IS NOT NULL").select(*columns)), whole.where("parent IS NULL")


def end_hashes(ends: DataFrame, params: TrieParams) -> DataFrame:
    """``key``, ``ends_sha256``: the SHA-256 of the ids (``conv_id``) that end in each node, ascending and comma-joined."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []

        def cut() -> None:
            if ids:
                out.append((key, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != key or len(ids) == params.piece:
                    cut()
                    key, ids = k, []
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["key", "first", "text"])
                out.clear()
        cut()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["key", "first", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                for k, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                    if k != key:
                        if key is not None:
                            out.append((key, digest.hexdigest()))
                        key, digest = k, hashlib.sha256(text.encode())
                    else:
                        digest.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["key", "ends_sha256"])
                out.clear()
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    ordered = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = ordered.mapInArrow(pieces, "key string, first long, text string")
    return joined.repartition(F.col("key")).sortWithinPartitions("key", "first").mapInArrow(hashed, "key string, ends_sha256 string")


def private_nodes(rows: DataFrame, params: TrieParams) -> DataFrame:
    """Nodes of segments whose root belongs to one distinct conversation: a path without branches, summed by windows."""
    over = Window.partitionBy("last").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + p)
    rows = rows.withColumn("total", total).withColumn("after", F.coalesce(F.sum("total").over(over), F.lit(0)))
    each = rows.select("*", F.posexplode("points").alias("at", "p"))
    inside = Window.partitionBy("last", "seg").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("next_root").isNull() & (F.col("at") == F.size("ids") - 1)
    path = lambda n: F.md5(F.concat_ws(",", "root", F.slice("ids", 1, n).cast("array<string>")).cast("binary"))
    return each.withColumn("rest", F.sum("p").over(inside) + F.col("after")).select(
        F.when(last, path(F.col("at") + 1)).alias("key"), (F.col("at") + 1).cast("long").alias("deep"), F.col("conv").alias("conv_id"),
        F.when(F.col("at") == 0, F.col("root_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_ended"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("rest")).alias("saved_tokens"), "seg")


def prefix_trie(conversations: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``: a row per node, the root first in
    depth. Runs jobs when called."""
    coded, _ = turn_ids(conversations)
    turns, every = rebuilt(coded, params)
    parts = materialize(segments(turns, every, params), "trie_segments")
    ends = parts.where("next_root IS NULL").select(F.col("node").alias("key"), "conv_id", "seg")
    # Equal segments of a root are one row. ``last`` names the whole sequence where only one goes through.
    rows = parts.groupBy("seg", "root", "ids", "points").agg(
        F.count("*").alias("n"), F.count_if(F.col("next_root").isNull()).alias("n_ended"), F.min("conv_id").alias("conv"), F.max("next_root").alias("next_root"))
    rows = materialize(rows, "trie_rows")
    whole = ends.join(parts.select("conv_id", "root"), "conv_id").groupBy("root").agg(F.min("key").alias("a"), F.max("key").alias("z"))
    single = whole.where("a = z").select("root", F.col("a").alias("last"))
    starts = rows.where("next_root IS NOT NULL").select(F.col("next_root").alias("root"), F.col("conv").alias("root_conv"))  # also of those that end there
    rows = materialize(rows.join(single, "root", "left").join(starts, "root", "left"), "trie_rows")
    shared = rows.where("last IS NULL OR seg = 0")
    deepest = shared.agg(F.max("seg")).first()[0]
    none = F.lit(None).cast("long")
    if deepest is None:
        return rows.select(*[none.alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], F.lit("").alias("ends_sha256"))
    private = private_nodes(rows.where("last IS NOT NULL AND seg > 0"), params)
    # What lies below the end of a full segment that leads to a path without branches.
    tails = rows.where("last IS NOT NULL AND seg > 0").withColumn("total", F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + p))
    over = Window.partitionBy("last").orderBy(F.col("seg").desc())
    tails = tails.select("seg", F.col("root").alias("next_root"), F.lit(1).cast("long").alias("below_children"), F.lit(1).cast("long").alias("below_leaves"),
                         ((F.col("n") - 1) * F.sum("total").over(over)).alias("below_saved"))
    found, tops = [private], None
    for seg in range(deepest, -1, -1):
        below = tails.where(F.col("seg") == seg + 1).drop("seg")
        if tops is not None:
            below = below.unionAll(tops.select(F.col("root").alias("next_root"), F.col("n_children").alias("below_children"), F.col("n_leaves").alias("below_leaves"),
                                               F.col("saved_tokens").alias("below_saved")))
        level = shared.where(F.col("seg") == seg).join(below, "next_root", "left")
        nodes = materialize(block_nodes(level, params), "trie_nodes")
        named, roots = merged(nodes, params)
        found.append(named.withColumn("seg", F.lit(seg).cast("long")))
        names = level.select("root", F.md5(F.col("root").cast("binary")).alias("key")).distinct()
        tops = materialize(roots.join(names, "key"), "trie_tops") if seg else roots
    found.append(tops.select(
        "key", "deep", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_ended", "n_children", "n_leaves", "saved_tokens", F.lit(0).cast("long").alias("seg")))
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionAll(more)
    hashes = end_hashes(ends, params)
    nodes = nodes.withColumn("key", F.when(F.col("n_ended") > 0, F.col("key")))  # all others have no ends
    some = nodes.where("key IS NOT NULL").join(hashes, "key", "left")
    rest = nodes.where("key IS NULL").withColumn("ends_sha256", F.lit(NO_END))
    depth = (F.col("seg") * params.segment + F.col("deep")).alias("depth")
    columns = ("conv_id", depth, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return some.select(*columns).unionAll(rest.select(*columns))


def prefix_trie_sql(params: TrieParams = TrieParams()) -> str:
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a & 255, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))))"""
    return f"""
WITH o AS MATERIALIZED (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
e AS MATERIALIZED (SELECT DISTINCT conv_id, conv_id - conv_id % {params.fan} AS base, {crc} % {params.most_shared} AS h FROM o),
s AS (SELECT e.*, least(h, coalesce(b.n, 0)) AS m FROM e LEFT JOIN (SELECT conv_id, n FROM o WHERE idx = 0) b ON b.conv_id = e.base),
r AS MATERIALIZED (
  SELECT s.conv_id, o.idx AS k, role, text FROM s JOIN o ON o.conv_id = s.base AND o.idx < s.h
  UNION ALL SELECT s.conv_id, o.idx - h + m, role, text FROM s JOIN o ON o.conv_id = s.conv_id AND o.idx >= s.h),
p AS MATERIALIZED (
  SELECT conv_id, k + 1 AS depth, length(text) AS points,
    string_agg(md5(md5(role) || text), ',') OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM e),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1),
q AS MATERIALIZED (
  SELECT prefix, p.depth, max(points) AS points, min(p.conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE l.depth = p.depth) AS ends FROM p JOIN l ON l.conv_id = p.conv_id GROUP BY 1, 2),
c AS MATERIALIZED (SELECT left(prefix, CAST(greatest(33 * (depth - 1) - 1, 0) AS BIGINT)) AS prefix, count(*) AS n_children FROM q WHERE depth > 0 GROUP BY 1),
u AS (
  SELECT left(prefix, CAST(greatest(33 * a - 1, 0) AS BIGINT)) AS prefix, sum((n_convs - 1) * points) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS leaves
  FROM (SELECT q.*, n_children, unnest(range(0, depth + 1)) AS a FROM q LEFT JOIN c USING (prefix)) GROUP BY 1)
SELECT q.conv_id, q.depth, t.conv_id AS parent_conv_id, q.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(q.ends, '')) AS ends_sha256
FROM q LEFT JOIN c USING (prefix) JOIN u USING (prefix) LEFT JOIN q t ON q.depth > 0 AND t.prefix = left(q.prefix, CAST(greatest(33 * (q.depth - 1) - 1, 0) AS BIGINT))
"""

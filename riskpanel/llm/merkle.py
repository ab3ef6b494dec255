"""Merkle manifest of a data set: one digest for all documents, and for each document the proof that leads to it.

Every document is a leaf; per language the leaves in ascending ``doc_id`` form a binary tree with a subroot, and the subroots form the tree of
the root. The trees are evaluated by time-forward processing: nodes are labelled level by level, a queue ordered by label carries each
digest to its parent, and a parent is computed when the queue yields its messages. The queue is external in two layers: inside ``2^bits``
consecutive nodes of a level it is a heap in a task, and the tops of such blocks are messages of the next round, which Spark's shuffle sorts and spills. The reversed
sweep goes the other way, from the root down: a block's top gets its proof suffix, and the block's queue, ordered by descending label, carries
suffixes to the leaves. So a task holds one block, and a tree of n leaves takes log(n) / bits rounds.

Defined cases: NULL fields are told from empty ones; documents without a language have a tree of their own, the first; within a language a NULL ``doc_id``
comes first and rows with the same ``doc_id`` follow in the order of their leaves, and equal rows are leaves of their own; a single leaf is its subroot and a
single subroot the root; an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.order import ranked
from riskpanel.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 12


def told(value: Column) -> Column:
    """``-`` for NULL, else the length in bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(told, fields)).cast("binary"), 256)


def sweep(digests: Sequence[str], levels: int) -> dict[tuple[int, int], list[str]]:
    """Time-forward processing of a block: the digests that reached each node, by label (level, position). Nodes get at most two messages."""
    queue = [(0, i, 0, d) for i, d in enumerate(digests)]
    heapify(queue)
    got: dict[tuple[int, int], list[str]] = {}
    while queue:
        level, at, _, digest = heappop(queue)
        messages = [digest]
        while queue and queue[0][:2] == (level, at):
            messages.append(heappop(queue)[3])
        got[level, at] = messages
        if level < levels:
            digest = hashlib.sha256("".join(messages).encode()).hexdigest() if level else digest
            heappush(queue, (level + 1, at >> 1, at & 1, digest))
    return got


def top(got: dict[tuple[int, int], list[str]], levels: int) -> str:
    return hashlib.sha256("".join(got[levels, 0]).encode()).hexdigest() if levels else got[0, 0][0]


def suffixes(got: dict[tuple[int, int], list[str]], levels: int, above: list[str]) -> list[list[str]]:
    """The reversed sweep: the proof of each leaf of a block. A step is ``l`` or ``r`` (side of the sibling) and the sibling's digest, or
    ``s`` for a node that is hashed alone."""
    queue = [(-levels, 0, above)]
    out: list[list[str]] = [[] for label in got if not label[0]]
    while queue:
        level, at, suffix = heappop(queue)
        if not level:
            out[at] = suffix
            continue
        messages = got[-level, at]
        if len(messages) == 1:
            heappush(queue, (level + 1, 2 * at, ["s", *suffix]))
        else:
            heappush(queue, (level + 1, 2 * at, ["r" + messages[1], *suffix]))
            heappush(queue, (level + 1, 2 * at + 1, ["l" + messages[0], *suffix]))
    return out


def _levels(n: int, bits: int) -> int:
    """Levels of a block in a level of n nodes: all that are left, if it is the only block."""
    return bits if n > 1 << bits else (n - 1).bit_length()


def forest(nodes: DataFrame, bits: int, name: str) -> list[DataFrame]:
    """The levels of all trees, a level every ``bits``: ``tree``, ``idx``, ``n`` (nodes of the tree in the level), ``digest``. ``nodes`` is the lowest; in
    the last each tree has one node, its root. Runs a job for each level."""

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n = table.column("n")[0].as_py()
        levels = _levels(n, bits)
        digest = top(sweep(table.column("digest").to_pylist(), levels), levels)
        return pa.table({"tree": table.column("tree").slice(0, 1), "idx": pa.array([table.column("idx")[0].as_py() >> bits], pa.int64()),
                         "n": pa.array([-(-n >> bits)], pa.int64()), "digest": [digest]})

    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 1) > 1:
        blocks = rounds[-1].select("tree", "idx", "n", "digest").groupBy("tree", F.shiftright("idx", bits).alias("block"))
        rounds.append(materialize(blocks.applyInArrow(up, "tree string, idx long, n long, digest string"), name))
    return rounds


def proofs(rounds: list[DataFrame], roots: DataFrame, bits: int, name: str) -> DataFrame:
    """``tree``, ``idx``, ``subroot``, ``root``, ``proof`` of the lowest level. ``roots``: ``tree``, ``proof``, ``subroot``, ``root`` of every tree's root."""

    def down(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("idx")
        levels = _levels(nodes.column("n")[0].as_py(), bits)
        steps = suffixes(sweep(nodes.column("digest").to_pylist(), levels), levels, above.column("proof")[0].as_py())
        k = len(nodes)
        same = {c: pa.repeat(above.column(c)[0], k) for c in ("subroot", "root")}
        return pa.table({"tree": nodes.column("tree"), "idx": nodes.column("idx"), **same, "proof": pa.array(steps, pa.list_(pa.string()))})

    result = "tree string, idx long, subroot string, root string, proof array<string>"
    known = roots.withColumn("idx", F.lit(0).cast("long"))
    for k, nodes in enumerate(reversed(rounds[:-1])):
        blocks = nodes.select("tree", "idx", "n", "digest").groupBy("tree", F.shiftright("idx", bits).alias("block"))
        known = blocks.cogroup(known.groupBy("tree", F.col("idx").alias("block"))).applyInArrow(down, result)
        if k + 2 < len(rounds):
            known = materialize(known, name)
    return known


def manifest(docs: DataFrame, tampered: Column | None = None, bits: int = BITS) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof`` (steps from leaf to root) of every row; with ``tampered``, a leaf computed otherwise, also
    ``tampered``. Runs jobs when called."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"),
        leaf([F.col(c) for c in FIELDS]).alias("digest"), (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"))
    leaves = materialize(ranked(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()], "merkle_leaves"), "merkle_leaves")
    trees = forest(leaves, bits, "merkle_nodes")
    # The trees' roots in bytewise order of the language, NULL ("-") before all others ("=...").
    subroots = trees[-1].select(F.lit("").alias("one"), "tree", "digest")
    subroots = materialize(ranked(subroots, "one", [F.col("tree").asc()], "merkle_subroots"), "merkle_subroots")
    upper = forest(subroots.select(F.col("one").alias("tree"), F.col("tree").alias("lang_tree"), "idx", "n", "digest"), bits, "merkle_upper")
    root = upper[-1].select("tree", F.array().cast("array<string>").alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    above = proofs(upper, root, bits, "merkle_proofs")
    named = subroots.join(above.select("idx", "proof", "root") if len(upper) > 1 else root.select(F.lit(0).cast("long").alias("idx"), "proof", "root"), "idx")
    known = materialize(named.select("tree", "proof", F.col("digest").alias("subroot"), "root"), "merkle_roots")
    if len(trees) > 1:
        known = proofs(trees, known, bits, "merkle_proofs")
    else:
        known = known.withColumn("idx", F.lit(0).cast("long"))
    out = leaves.join(known, ["tree", "idx"]).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof", "tampered")
    return out if tampered is not None else out.drop("tampered")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    def step(node: Column, sibling: Column) -> Column:
        side, digest = F.substring(sibling, 1, 1), F.substring(sibling, 2, 64)
        joined = F.when(side == "l", F.concat(digest, node)).when(side == "r", F.concat(node, digest)).otherwise(node)
        return F.sha2(joined.cast("binary"), 256)

    return F.aggregate(proof, leaf, step)


def report(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The manifest with digests of the proofs, checked against documents of which those with ``crc32(doc_id)`` divisible by 7 were tampered with (one
    character more in ``n_chars``)."""
    fields = [F.col(c) for c in FIELDS]
    fields[FIELDS.index("n_chars")] = F.col("n_chars") + 1
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = manifest(docs, F.when(changed, leaf(fields)).otherwise(leaf([F.col(c) for c in FIELDS])), bits)
    siblings = F.array_join(F.transform("proof", lambda s: F.substring(s, 2, 64)), "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), fold(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def report_sql() -> str:
    told = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    said = lambda n_chars: f"sha256({' || '.join(told(n_chars if c == 'n_chars' else c) for c in FIELDS)})"
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a & 255, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))))"""
    fold = """list_reduce(list_prepend(tampered, steps), lambda a, s: sha256(CASE s[1] WHEN 'l' THEN s[2:] || a WHEN 'r' THEN a || s[2:] ELSE a END))"""

    def grown(nodes: str, name: str) -> str:
        return f"""
{name} AS (
  SELECT 0 AS level, tree, idx, n, digest FROM {nodes}
  UNION ALL
  SELECT level + 1, tree, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY level, tree, idx // 2)"""

    def steps(nodes: str, name: str) -> str:
        """Siblings of every lowest node; a level with one node has none."""
        return f"""
  SELECT l.tree, l.idx, coalesce(list(CASE WHEN s.idx IS NULL THEN 's' WHEN s.idx < u.idx THEN 'l' || s.digest ELSE 'r' || s.digest END ORDER BY u.level)
           FILTER (WHERE u.n > 1), []) AS steps
  FROM {nodes} l JOIN {name} u ON u.tree = l.tree AND u.idx = l.idx // CAST(pow(2, u.level) AS BIGINT)
    LEFT JOIN {name} s ON s.tree = u.tree AND s.level = u.level AND s.idx = xor(u.idx, 1) AND u.n > 1
  GROUP BY ALL"""

    return f"""
WITH RECURSIVE raw AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce('=' || lang, '-') AS tree, {said('n_chars')} AS digest,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN {said('n_chars + 1')} ELSE {said('n_chars')} END AS tampered FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM raw),
{grown('leaves', 'lower_nodes')},
subroots AS MATERIALIZED (SELECT '' AS tree, tree AS lang_tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM lower_nodes WHERE n = 1),
{grown('subroots', 'upper_nodes')},
lower_steps AS ({steps('leaves', 'lower_nodes')}),
upper_steps AS ({steps('subroots', 'upper_nodes')}),
r AS (SELECT digest AS root FROM upper_nodes WHERE n = 1),
p AS (SELECT doc_id, l.digest AS leaf, s.digest AS subroot, root, tampered, list_concat(ls.steps, us.steps) AS steps
      FROM leaves l JOIN lower_steps ls ON ls.tree = l.tree AND ls.idx = l.idx JOIN subroots s ON s.lang_tree = l.tree JOIN upper_steps us ON us.idx = s.idx CROSS JOIN r),
f AS (SELECT *, {fold} AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""

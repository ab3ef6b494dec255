"""Sharding by a permutation-filled lookup table. DataFrame functions only.

Each shard prefers the slots of a table of prime size in an order of its own, ``offset + k * skip``. The shards take turns, each claiming the
first free slot of its order, until the table is full; so shards hold nearly equal numbers of slots, and adding or removing a shard
moves few others. A row's key is hashed to a slot, and the table, whose size is a parameter, is broadcast: placement costs one lookup.

Defined cases: a NULL key is placed like the empty string; equal keys share a shard; an empty table gives no rows. Only the key columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "|"


@dataclass(frozen=True)
class ShardParams:
    shards: tuple[str, ...] = tuple(f"shard-{i:02d}" for i in range(16))
    slots: int = 2039  # a prime, of the order of 100 slots a shard


def hash60(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(params: ShardParams) -> list[int]:
    """The number of the shard that owns each slot."""
    m, n = params.slots, len(params.shards)
    if n < 1 or n > m or m < 2 or any(m % d == 0 for d in range(2, int(m**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    place = [hash60("offset" + s) % m for s in params.shards]
    skip = [hash60("skip" + s) % (m - 1) + 1 for s in params.shards]
    owner, free = [-1] * m, m
    while True:
        for i in range(n):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % m
            owner[place[i]] = i
            free -= 1
            if not free:
                return owner


def lookup_table(spark: SparkSession, params: ShardParams) -> DataFrame:
    """``slot``, ``shard``: ``params.slots`` rows."""
    owners = F.split(F.lit(",".join(map(str, fill(params)))), ",")
    names = F.split(F.lit(SEPARATOR.join(params.shards)), SEPARATOR.replace("|", "[|]"))
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select(
        F.col("slot").cast("long"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(key: Column, params: ShardParams) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % params.slots


def place(rows: DataFrame, key: str = "doc_id", params: ShardParams = ShardParams()) -> DataFrame:
    """``rows`` with ``slot`` and ``shard`` in place of any columns of these names."""
    table = F.broadcast(lookup_table(rows.sparkSession, params))  # params.slots rows
    return rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), params)).join(table, "slot", "left")


def write(rows: DataFrame, path: str, key: str = "doc_id", params: ShardParams = ShardParams(), files: int = 8) -> None:
    """One folder per shard with at most ``files`` files each; rows of one shard go to several tasks."""
    placed = place(rows, key, params)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(files))
    placed.repartition(len(params.shards) * files, "shard", spread).write.partitionBy("shard").parquet(path)


def place_sql(params: ShardParams = ShardParams()) -> str:
    """``doc_id``, ``slot``, ``shard`` in SQL, with the table filled turn by turn."""
    names = ", ".join(f"'{s}'" for s in params.shards)
    h = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
    m, n = params.slots, len(params.shards)
    return f"""
WITH RECURSIVE p AS (SELECT list_transform([{names}], lambda x: {h.format("'offset' || x")} % {m}) AS o,
    list_transform([{names}], lambda x: {h.format("'skip' || x")} % {m - 1} + 1) AS k),
f(step, owner) AS (
  SELECT 0, list_transform(range(0, {m}), lambda x: -1)
  UNION ALL
  SELECT step + 1, list_concat(list_concat(owner[1:slot], [step % {n}]), owner[slot + 2:]) FROM (
    SELECT step, owner, (o + k * list_filter(range(0, {m}), lambda j: owner[(o + j * k) % {m} + 1] < 0)[1]) % {m} AS slot
    FROM (SELECT f.step, f.owner, p.o[f.step % {n} + 1] AS o, p.k[f.step % {n} + 1] AS k FROM f, p WHERE f.step < {m}))),
t AS (SELECT owner FROM f WHERE step = {m}),
d AS (SELECT doc_id, {h.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % {m} AS slot FROM documents)
SELECT doc_id, slot, [{names}][t.owner[slot + 1] + 1] AS shard FROM d, t
"""

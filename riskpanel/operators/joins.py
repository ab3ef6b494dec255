"""Joins. No side is broadcast by hand: Spark broadcasts what its size statistics allow and otherwise shuffles,
and adaptive execution splits skewed partitions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_left(df: DataFrame, lookup: DataFrame, keys: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """Left equi-join to a lookup; ``keys`` maps left names to lookup names."""
    side = lookup.select(*[F.col(k).alias(f"k_{k}") for k in keys.values()], *columns)
    on = [F.col(left) == F.col(f"k_{right}") for left, right in keys.items()]
    return df.join(side, on, "left").drop(*[f"k_{k}" for k in keys.values()])


def lookup_inner(df: DataFrame, lookup: DataFrame, keys: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """Left join followed by "key found", written as the inner join it is."""
    side = lookup.select(*[F.col(k).alias(f"k_{k}") for k in keys.values()], *columns)
    on = [F.col(left) == F.col(f"k_{right}") for left, right in keys.items()]
    return df.join(side, on, "inner").drop(*[f"k_{k}" for k in keys.values()])


def lookup_null_safe(df: DataFrame, other: DataFrame, keys: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """Left join in which a missing key matches a missing key."""
    side = other.select(*[F.col(k).alias(f"k_{k}") for k in keys.values()], *columns)
    on = [F.col(left).eqNullSafe(F.col(f"k_{right}")) for left, right in keys.items()]
    return df.join(side, on, "left").drop(*[f"k_{k}" for k in keys.values()])


def full_join(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Full outer join with differently named keys, which keep their left names."""
    side = right
    for name in keys.values():
        side = side.withColumnRenamed(name, f"k_{name}")
    joined = left.join(side, [F.col(a) == F.col(f"k_{b}") for a, b in keys.items()], "full")
    for a, b in keys.items():
        joined = joined.withColumn(a, F.coalesce(F.col(a), F.col(f"k_{b}"))).drop(f"k_{b}")
    return joined


def snapshot(lookup: DataFrame, published: Column, wanted: date, shift_days: int = 1) -> DataFrame:
    """The rows of a dated lookup whose publication date, shifted, is the wanted one."""
    return lookup.where(F.date_add(published, shift_days) == F.lit(wanted))


def remap_codes(df: DataFrame, code: str, crosswalk: DataFrame) -> DataFrame:
    """Several codes -> one reporting unit; codes outside the crosswalk stay."""
    side = crosswalk.select(F.col("code").alias("k_code"), "unit")
    joined = df.join(side, F.col(code) == F.col("k_code"), "left")
    return joined.withColumn(code, F.coalesce("unit", code)).drop("k_code", "unit")


def representatives(df: DataFrame, code: str, crosswalk: DataFrame) -> DataFrame:
    """Drops all but the representative member of each merged unit, then gives it the unit's code."""
    side = crosswalk.select(F.col("code").alias("k_code"), "unit", "keep")
    joined = df.join(side, F.col(code) == F.col("k_code"), "left").where(F.coalesce("keep", F.lit(True)))
    return joined.withColumn(code, F.coalesce("unit", code)).drop("k_code", "unit", "keep")

"""Unions, unpivots and pivots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_tagged(frames: dict[str, DataFrame], tag: str = "type") -> DataFrame:
    return stack([df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide -> long, keeping NULLs."""
    return df.unpivot(list(ids), list(columns), name, value)


def to_wide(df: DataFrame, ids: Sequence[str], name: str, value: str, levels: Sequence[str]) -> DataFrame:
    """Long -> wide over stated levels. Of several values in a cell the largest is taken, so the result does not depend on chance."""
    return df.groupBy(*ids).pivot(name, list(levels)).agg(F.max(value))


def map_numeric(df: DataFrame, fn, keep: Sequence[str] = ()) -> DataFrame:
    """Applies ``fn`` to every numeric column not listed in ``keep``."""
    return df.select(*[
        fn(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.NumericType) and f.name not in keep else F.col(f.name)
        for f in df.schema.fields
    ])


def like_columns(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.select(*other.columns)

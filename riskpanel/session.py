"""Session helpers: where intermediate tables live and how a plan is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a missing setting is an
    error, because a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of their own
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="riskpanel-")
    spark.sparkContext.setCheckpointDir(path)
    return shared_dir(spark)


_paths: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    _paths.append(f"{shared_dir(spark)}/riskpanel/{re.sub('[^A-Za-z0-9_]+', '_', name)}-{uuid.uuid4().hex}")
    return _paths[-1]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the intermediate tables that were written inside it, so results must be used or written before."""
    first = len(_paths)
    try:
        yield
    finally:
        jvm = spark._jvm
        for path in _paths[first:]:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        del _paths[first:]


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and unlike a checkpointed RDD keeps column pruning,
    filter pushdown and size statistics (so Spark's own broadcast check works) for whatever reads it next.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small constant table inside the plan. Unlike a parallelized list it has a known size, so a join to it is
    broadcast instead of shuffling the other side."""
    columns = [c.split() for c in schema.split(", ")]
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, columns, strict=True)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))

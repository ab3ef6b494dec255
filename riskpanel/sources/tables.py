"""CSV and parquet tables: readers with declared schemas, panel and result sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Header CSV; several paths (one per year) are one scan."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(paths)


LINE, FILE, BROKEN = "broken_line", "source_file", "is_broken"


def ingest_csv(spark: SparkSession, source: str | Sequence[str], schema: T.StructType, path: str) -> None:
    """Parses header CSV files once, into a parquet dataset at ``path`` that a second run replaces as a whole.

    Lines that do not fit the declared schema (a text in place of a number, too few or too many fields) are kept apart, whole and with the name of
    their file. A file with other column names is refused. All columns are parsed, so a line is judged by every field, whatever is read later.
    """
    paths = [source] if isinstance(source, str) else list(source)
    declared = T.StructType([*schema.fields, T.StructField(LINE, T.StringType())])
    options = {"header": True, "enforceSchema": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE}
    rows = spark.read.schema(declared).options(**options).csv(paths).select(
        *schema.names, LINE, F.col("_metadata.file_path").alias(FILE), F.col(LINE).isNotNull().alias(BROKEN))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BROKEN).parquet(path)


def _ingested(spark: SparkSession, path: str, schema: T.StructType, broken: bool) -> DataFrame:
    more = [T.StructField(LINE, T.StringType()), T.StructField(FILE, T.StringType()), T.StructField(BROKEN, T.BooleanType())]
    rows = spark.read.schema(T.StructType([*schema.fields, *more])).parquet(path)
    return rows.where(F.col(BROKEN) if broken else ~F.col(BROKEN))


def read_ingested(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that fit the schema."""
    return _ingested(spark, path, schema, False).select(*schema.names)


def read_quarantine(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that do not, with their files."""
    return _ingested(spark, path, schema, True).select(FILE, LINE)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parts(df: DataFrame, path: str, parts: Sequence[str]) -> None:
    """Writes rows by the partition columns ``parts``. Partitions that have rows here are replaced and all others stay, so a second run leaves the
    same rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_panel(panel: DataFrame, path: str, geography: str) -> None:
    """Puts one geography's weekly panel into the panel dataset, in place of what it had there."""
    write_parts(panel.withColumn("geo", F.lit(geography)), path, ["geo"])


def read_panel(spark: SparkSession, path: str, geography: str | None = None) -> DataFrame:
    """The panel dataset, or one geography of it (a partition filter: of other folders only the names are read). Partition
    values stay strings, so a level named like a number does not become one."""
    types = {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}
    df = _with_conf(spark, types, lambda: spark.read.parquet(path))
    return df if geography is None else df.where(F.col("geo") == geography)


def write_predictions(scored: DataFrame, path: str) -> None:
    """Puts scored rows into the prediction dataset, by specification and outcome. Rows are brought together by folder first, in files of even size,
    or each task would leave a file in every folder."""
    write_parts(scored.hint("rebalance", "spec", "outcome_label"), path, ["spec", "outcome_label"])


def write_results(df: DataFrame, path: str, parts: Sequence[str]) -> None:
    """Puts result rows into the result dataset under the columns ``parts``, such as ``period`` and ``geo``."""
    write_parts(df, path, parts)


def append_results(df: DataFrame, path: str, **parts: str) -> None:
    """Adds the result rows of one block, named by constant partition columns such as ``level`` or ``period``; a block that was written before is replaced."""
    write_parts(df.withColumns({k: F.lit(v) for k, v in parts.items()}), path, list(parts))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The appended results; partition values stay strings."""
    return _with_conf(spark, {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}, lambda: spark.read.parquet(path))


def _with_conf(spark: SparkSession, settings: dict[str, str], read: Callable[[], DataFrame]) -> DataFrame:
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return read()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

"""Scans, catalog tables, versioned replacement, and plain sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwire.session import work_path


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_not_null(df: DataFrame, columns: list[str], not_null: list[str]) -> DataFrame:
    """Pruned scan: only ``columns``, only rows where every ``not_null`` column is set."""
    for c in not_null:
        df = df.where(F.col(c).isNotNull())
    return df.select(*columns)


def scan_dates(df: DataFrame, columns: list[str], date_column: str) -> DataFrame:
    """Scan with one column parsed to DATE (junk gives NULL)."""
    day = F.col(date_column)
    if isinstance(df.schema[date_column].dataType, T.StringType):
        day = day.try_cast("date")
    return df.select(*columns).withColumn(date_column, day.cast("date"))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def create_if_absent(
    spark: SparkSession, name: str, schema: T.StructType, path: str | None = None
) -> DataFrame:
    """The table, created empty with ``schema`` when it does not exist yet."""
    if not spark.catalog.tableExists(name):
        _save(spark.createDataFrame([], schema), name, "errorifexists", path)
    return spark.table(name)


def drop_table(spark: SparkSession, name: str) -> bool:
    """True when the table is gone afterwards."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return not spark.catalog.tableExists(name)


def rename_table(spark: SparkSession, old: str, new: str) -> DataFrame:
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
    return spark.table(new)


def _save(df: DataFrame, name: str, mode: str, path: str | None) -> DataFrame:
    writer = df.write.format("parquet").mode(mode)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def copy_table(spark: SparkSession, source: str, target: str, path: str | None = None) -> DataFrame:
    """Copy with the target replaced."""
    return _save(spark.table(source), target, "overwrite", path)


def append_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    return _save(df, name, "append", path)


def write_version(df: DataFrame, base: str | None = None, label: str = "table") -> str:
    """Write a new version of a table and return its path.

    Spark cannot overwrite files it is still reading, so a replacement goes to a fresh path and
    the caller switches to it.
    """
    path = work_path(df.sparkSession, label) if base is None else f"{base}/{label}"
    df.write.parquet(path)
    return path


def replace_table(df: DataFrame, label: str = "table") -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(write_version(df, label=label))


def copy_between(spark: SparkSession, source_path: str, target_path: str) -> DataFrame:
    """Copy a table from one location to another, replacing what is there."""
    df = spark.read.parquet(source_path)
    df.write.mode("overwrite").parquet(target_path)
    return spark.read.schema(df.schema).parquet(target_path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)

"""Session settings, the shared work folder, and the size check behind every broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side with at most this many (narrow) rows may be broadcast; above it joins shuffle and
#: adaptive execution splits skewed partitions.
BROADCAST_MAX_ROWS = 200_000
#: And at most about this many bytes, for sides whose rows are wide.
BROADCAST_MAX_BYTES = 128 << 20

_NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)
_LONG_TYPES = (T.StringType, T.BinaryType, *_NESTED_TYPES)

_SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Vector summaries keep a hash entry per day; the default of 128 would sort whole vectors.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}

#: Rows and bytes of a batch sent to Python where long texts are carried: a task holds few batches at a time, in the
#: JVM and in Python, and texts come in again with the columns carried along.
_SMALL_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}

_local_base: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the library relies on to an existing session."""
    for key, value in _SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the batches that go to Python in this session; results do not depend on them."""
    for key, value in _SMALL_BATCHES.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bellwire")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def work_base(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master falls back to a temporary folder; on a cluster that folder would exist
    on one machine only, so a missing setting is an error there.
    """
    global _local_base
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="bellwire-")
    return _local_base


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the work folder; never reused, so retries cannot see old data."""
    return f"{work_base(spark)}/bellwire/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the work folder and read it back.

    Cuts the lineage with durable files, so later stages neither recompute the input nor see
    different partition bounds after an executor is lost.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_evenly(df: DataFrame) -> DataFrame:
    """The same rows dealt out evenly before costly work on each: a scan has no more busy tasks than its files have
    row groups. The number of partitions follows the cores, and the size of the files once these have more splits.
    """
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of one row: fixed widths, plus the length of texts, binaries and nested values."""
    fixed = sum(8 for f in df.schema if not isinstance(f.dataType, _LONG_TYPES))
    texts = [F.octet_length(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    nested = [F.length(F.to_json(F.struct(f"`{f.name}`"))) for f in df.schema if isinstance(f.dataType, _NESTED_TYPES)]
    return sum((F.coalesce(part, F.lit(0)) for part in texts + nested), F.lit(fixed + 16).cast("long"))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring that ``df`` has at most ``max_rows`` rows and about ``max_bytes``.

    The count sends one row per task. A larger side is returned as it is, without a hint: the join then shuffles
    on its keys and adaptive execution splits the skewed partitions.
    """
    rows, size = df.agg(F.count("*"), F.sum(_row_bytes(df))).first()
    if rows > max_rows or (size or 0) > max_bytes:
        return df
    return F.broadcast(df)

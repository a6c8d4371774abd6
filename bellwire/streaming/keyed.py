"""A sink bucketed by key, so a micro-batch looks only into the buckets its own keys fall into."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwire.session import broadcast_if_small

BUCKET, BATCH = "bucket", "batch_no"
#: Buckets of a new sink. A sink keeps the number it was begun with, so it must not change between runs.
BUCKETS = 32
_NO_BUCKET = -1


@dataclass(frozen=True)
class KeyedSink:
    """Parquet files under ``bucket=B/batch_no=N``.

    The bucket is a hash of ``key``; rows with a NULL key, which nothing looks up, are spread by ``spread``.
    A retried micro-batch replaces its own partitions, as its rows fall into the same buckets again.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    spread: str
    buckets: int = BUCKETS

    def bucket_of(self) -> Column:
        chosen = F.coalesce(F.col(self.key).cast("string"), F.col(self.spread).cast("string"))
        return F.pmod(F.xxhash64(chosen), F.lit(self.buckets)).cast("int")

    def create(self) -> None:
        """An empty partition, so the sink can be read before and without any micro-batch."""
        empty = self.spark.createDataFrame([], self.schema)
        empty.write.mode("overwrite").parquet(f"{self.path}/{BUCKET}={_NO_BUCKET}/{BATCH}=-1")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """Stored rows of the given buckets with their partition columns; other buckets are not even listed."""
        layout = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType()), T.StructField(BATCH, T.LongType())])
        reader = self.spark.read.schema(layout).option("basePath", self.path)
        if buckets is None:
            return reader.parquet(self.path)
        wanted = ",".join(str(b) for b in (_NO_BUCKET, *buckets))
        return reader.parquet(f"{self.path}/{BUCKET}={{{wanted}}}")

    def seen_keys(self, batch: DataFrame, batch_no: int) -> DataFrame:
        """Keys of ``batch`` that earlier micro-batches stored.

        The buckets touched, at most ``buckets`` numbers, choose what is listed and read; of that only the key
        column is read, and while the keys of the batch are counted small they are broadcast, so stored rows
        are not shuffled.
        """
        keyed = batch.where(F.col(self.key).isNotNull())
        touched = sorted(r[0] for r in keyed.select(self.bucket_of()).distinct().collect())
        stored = self.read(touched).where(F.col(BATCH) < batch_no).select(self.key)
        keys = keyed.select(self.key).distinct()
        return stored.join(broadcast_if_small(keys), self.key, "left_semi").distinct()

    def write(self, rows: DataFrame, batch_no: int) -> None:
        """Store a micro-batch; large buckets are written by several tasks, small ones share a task."""
        placed = rows.select(*self.schema.names).withColumn(BUCKET, self.bucket_of())
        placed = placed.withColumn(BATCH, F.lit(batch_no).cast("long")).hint("rebalance", BUCKET)
        writer = placed.write.partitionBy(BUCKET, BATCH).mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.read().drop(BUCKET, BATCH)


def each_keyed_batch(
    stream: DataFrame,
    sink: KeyedSink,
    step: Callable[[DataFrame, DataFrame], DataFrame],
    drain: Callable,
    checkpoint: str,
) -> DataFrame:
    """Run ``step(new rows, keys already stored)`` per micro-batch and store its result."""

    def process(batch: DataFrame, batch_no: int) -> None:
        sink.write(step(batch, sink.seen_keys(batch, batch_no)), batch_no)

    sink.create()
    drain(stream.writeStream.foreachBatch(process), checkpoint)
    return sink.rows()

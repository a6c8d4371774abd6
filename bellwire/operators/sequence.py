"""Global order without a global sort task: ids 1..N, running sums, time-series folds.

An unpartitioned window would pull every row into one task. Here rows are range-partitioned and
sorted in place, stored once, and each partition is shifted by the totals of the partitions before
it. Only those totals (one row per partition) meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bellwire.session import materialise

_SLOT = "_slot"
_PART = "_part"
# monotonically_increasing_id keeps the partition number above bit 33 and the position below.
_POSITION_BITS = 33


def _range_placed(df: DataFrame, order: Sequence[Column | str], num_partitions: int | None) -> DataFrame:
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn(_SLOT, F.monotonically_increasing_id())
    )
    # Range bounds come from sampling, so both passes must read the same stored placement.
    return materialise(placed, "ranged").withColumn(_PART, F.shiftright(_SLOT, _POSITION_BITS))


def _before(cols: dict[str, Column]) -> list[Column]:
    earlier = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    return [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for name, c in cols.items()]


def number_rows(
    df: DataFrame,
    order: Sequence[Column | str],
    out: str = "id",
    start: int = 1,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = start, start+1, ... in the given order.

    ``order`` must end in a unique column: that makes the result repeatable and lets the range
    bounds split a key value that holds a large share of the rows.
    """
    placed = _range_placed(df, order, num_partitions)
    sizes = placed.groupBy(_PART).agg(F.count("*").alias("_n"))
    offsets = sizes.select(_PART, *_before({"_before": F.col("_n")}))
    position = F.col(_SLOT).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    keep = [c for c in df.columns if c != out]
    # offsets has one row per partition, so its size is bounded by the partition count.
    return placed.join(F.broadcast(offsets), _PART).select(
        (F.col("_before") + position + F.lit(start)).cast("bigint").alias(out), *keep
    )


def running_sums(
    df: DataFrame,
    order: Sequence[Column | str],
    sums: dict[str, str],
    num_partitions: int | None = None,
) -> DataFrame:
    """Add, for each ``new: column``, the sum of ``column`` over all rows before this one."""
    placed = _range_placed(df, order, num_partitions)
    totals = placed.groupBy(_PART).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    offsets = totals.select(_PART, *_before({f"_b_{n}": F.col(f"_t_{n}") for n in sums}))
    inside = W.partitionBy(_PART).orderBy(_SLOT).rowsBetween(W.unboundedPreceding, -1)
    added = [
        (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_b_{n}")).alias(n)
        for n, c in sums.items()
    ]
    return placed.join(F.broadcast(offsets), _PART).select(*df.columns, *added)


def reindex_by_column(df: DataFrame, column: str, id_col: str = "id", **kw) -> DataFrame:
    """Sort by ``column`` and assign ids 1..N; equal values keep their old id order."""
    if column not in df.columns or column == id_col:
        raise ValueError(f"column {column!r} does not exist in the table")
    if id_col not in df.columns:
        raise ValueError(f"id column {id_col!r} does not exist in the table")
    return number_rows(df, [column, id_col], out=id_col, **kw).select(*df.columns)


def resolve_row_id(df: DataFrame, id_col: str, order: Sequence[str], out: str = "rid") -> DataFrame:
    """Use ``id_col`` as the row id where the table has it, else number the rows in ``order``."""
    if id_col in df.columns:
        return df.withColumn(out, F.col(id_col))
    return number_rows(df, list(order), out=out)


def time_series_folds(df: DataFrame, date_col: str, k: int = 5, tie_break: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Every row once per fold it belongs to, with ``fold`` 1..k and ``role`` train/test.

    n rows in date order, test size t = n // (k+1); fold i tests rows n-(k-i+1)t+1 .. n-(k-i)t
    and trains on every row before them.
    """
    order = [date_col] + ([tie_break] if tie_break else [])
    seq = number_rows(df, order, out="row_no", num_partitions=num_partitions)
    n = seq.select(F.count("*")).scalar()
    size = F.floor(n / F.lit(k + 1))
    test_start = n - (F.lit(k + 1) - F.col("fold")) * size
    return (
        seq.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
        .withColumn(
            "role",
            F.when(F.col("row_no") <= test_start, "train").when(
                F.col("row_no") <= test_start + size, "test"
            ),
        )
        .where(F.col("role").isNotNull())
    )

"""Table maintenance as DataFrame rewrites: update, delete, columns, filters, change counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwire.functions.timez import utc_date


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def table_info(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    schema = "cid int, name string, type string"
    return df.sparkSession.createDataFrame(rows, schema)


def ensure_column(df: DataFrame, name: str, dtype: str = "double") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


def keyed_update(
    table: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], order: str | None = None
) -> DataFrame:
    """Set ``columns`` from ``updates`` where the key matches; other rows stay.

    Of several updates for one key the one with the largest ``order`` counts, ties and a missing
    ``order`` being settled by the largest values, so no row is ever repeated. A matched NULL
    overwrites, as an UPDATE would.
    """
    values = F.struct(*columns)
    last = values if order is None else F.struct(F.col(order), values)
    one = updates.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(values, last).alias("_v"))
    new = one.select("_key", F.lit(True).alias("_hit"), *[F.col(f"_v.{c}").alias(f"_new_{c}") for c in columns])
    joined = ensure_all(table, updates, columns).join(new, F.col(key) == F.col("_key"), "left")
    changed = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(changed).drop("_key", "_hit", *[f"_new_{c}" for c in columns])


def ensure_all(table: DataFrame, updates: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        table = ensure_column(table, c, updates.schema[c].dataType.simpleString())
    return table


def delete_by_id(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti").select(*table.columns)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """Types and ids are kept; a missing column is a no-op."""
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Types are kept; a missing column is a no-op."""
    return df.withColumnRenamed(old, new)


def dedup_column_names(df: DataFrame) -> DataFrame:
    """Keep the first of every repeated column name."""
    unique = [f"_c{i}" for i in range(len(df.columns))]
    seen: dict[str, str] = {}
    for name, alias in zip(df.columns, unique):
        seen.setdefault(name, alias)
    return df.toDF(*unique).select(*[F.col(alias).alias(name) for name, alias in seen.items()])


def filter_by_date(
    df: DataFrame, column: str, start: str | date | None = None, end: str | date | None = None
) -> DataFrame:
    """Rows whose UTC date lies between the inclusive bounds; unparseable dates drop out.

    A typed date or timestamp column is compared as it is, which a Parquet scan can prune.
    """
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.DateType):
        day = F.col(column)
    elif isinstance(dtype, T.StringType):
        day = utc_date(column)
    else:
        day = None
    if day is not None:
        if start is not None:
            df = df.where(day >= F.lit(start).cast("date"))
        return df if end is None else df.where(day <= F.lit(end).cast("date"))
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date").cast(dtype))
    if end is not None:
        df = df.where(F.col(column) < F.date_add(F.lit(end).cast("date"), 1).cast(dtype))
    return df


def filter_rows_in(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Keep listed values. Rows where the column is NULL stay: ``NULL NOT IN (...)`` deletes nothing."""
    return df.where(F.col(column).isin(list(allowed)) | F.col(column).isNull())


def count_nulls(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.count_if(F.col(column).isNull()).alias("n_nulls"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.select(F.count("*").alias("n_rows"))


def drop_incomplete(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(subset))


def reorder_by(df: DataFrame, column: str) -> DataFrame:
    """Range-partition and sort, so a written table is laid out in ``column`` order."""
    return df.repartitionByRange(column).sortWithinPartitions(column)


def sample_first(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.orderBy(column).limit(n)


def pending(df: DataFrame, text: str, target: str, skip_blank_text: bool = True, blank_is_pending: bool = False) -> DataFrame:
    """Rows that still need ``target``.

    The lexicon scorer and title cleaner skip missing text; the model scorers take it as ''.
    ``blank_is_pending`` also counts '' in ``target`` as missing.
    """
    todo: Column = F.col(target).isNull()
    if blank_is_pending:
        todo = todo | (F.col(target) == "")
    if skip_blank_text:
        todo = todo & F.col(text).isNotNull() & (F.col(text) != "")
    return df.where(todo)


def change_report(before: DataFrame, after: DataFrame, key: str = "id", compare: Sequence[str] = ()) -> DataFrame:
    """One row: how many rows were removed, added, updated in ``compare``, and kept as they were."""
    def side(df: DataFrame, key_name: str, image: str) -> DataFrame:
        values = F.struct(*compare) if compare else F.lit(0)
        return df.select(F.col(key).alias(key_name), values.alias(image))

    old, new = side(before, "_k", "_old"), side(after, "_j", "_new")
    both = old.join(new, F.col("_k") == F.col("_j"), "full_outer")
    matched = F.col("_k").isNotNull() & F.col("_j").isNotNull()
    same = F.col("_old").eqNullSafe(F.col("_new"))
    return both.select(
        F.count_if(F.col("_j").isNull()).alias("removed"),
        F.count_if(F.col("_k").isNull()).alias("added"),
        F.count_if(matched & ~same).alias("updated"),
        F.count_if(matched & same).alias("kept"),
    )

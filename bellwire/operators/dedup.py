"""Keep-first, unique-key inserts, and the null-aware merge of source tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bellwire.operators.sequence import number_rows


def keep_first(df: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """One row per key group, the one with the smallest id; NULL keys form one group.

    Spark limits each key to one row inside every map task before the shuffle (window group
    limit), so a key with a large share of the rows sends one row per task.
    """
    if not keys:
        raise ValueError("keys must contain at least one column name")
    first = F.row_number().over(W.partitionBy(*keys).orderBy(id_col))
    return df.withColumn("_rn", first).where("_rn = 1").drop("_rn")


def insert_or_ignore(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order: str
) -> DataFrame:
    """Rows of ``batch`` a unique key would let in: first of each key, not yet in target.

    A NULL in the key never collides, so such rows all pass and are kept out of the join.
    """
    keys = list(keys)
    keyed = reduce(and_, [F.col(k).isNotNull() for k in keys])
    first = keep_first(batch.where(keyed), keys, order)
    fresh = first.join(target.select(*keys).where(keyed), keys, "left_anti")
    return fresh.select(*batch.columns).unionByName(batch.where(~keyed))


def merge_not_in(
    target: DataFrame, source: DataFrame, key: str = "url", null_mode: str = "safe"
) -> DataFrame:
    """Source rows whose key is not in target.

    ``null_mode="sql"`` follows ``NOT IN``: a NULL key in target lets nothing in, and a NULL key in
    source gets in only while target is empty. ``"safe"`` follows ``NOT EXISTS``: NULL equals
    nothing, so such rows always get in. Repeats inside source all go in. Both run as an equi
    anti join; the null rules are two scalar counts.
    """
    known = target.select(key)
    fresh = source.where(F.col(key).isNotNull()).join(
        known.where(F.col(key).isNotNull()), key, "left_anti"
    )
    unkeyed = source.where(F.col(key).isNull())
    if null_mode == "safe":
        return fresh.select(*source.columns).unionByName(unkeyed)
    if null_mode != "sql":
        raise ValueError(f"unknown null_mode {null_mode!r}")
    null_keys = known.select(F.count_if(F.col(key).isNull())).scalar()
    rows = known.select(F.count("*")).scalar()
    return (
        fresh.select(*source.columns)
        .where(null_keys == 0)
        .unionByName(unkeyed.where(rows == 0))
    )


def tag_sources(tables: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Union of the source tables, tagged with name and position (earlier sources win)."""
    if not tables:
        raise ValueError("no tables to merge")
    parts = [
        t.select(*columns).withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(rank))
        for rank, (name, t) in enumerate(tables.items(), start=1)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merge_sources(
    target: DataFrame,
    tagged: DataFrame,
    key: str = "url",
    null_mode: str = "safe",
) -> DataFrame:
    """Insert the tagged sources one after the other, each against target plus earlier sources.

    All sources go in one pass: a key's first rank (target = 0) decides who may insert it, so the
    plan holds one pre-aggregated shuffle and one join whatever the number of sources. Repeats
    inside the winning source all go in.
    """
    known = target.select(key, F.lit(0).alias("source_rank"))
    first = (
        known.unionByName(tagged.select(key, "source_rank"))
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min("source_rank").alias("_first"))
    )
    keyed = tagged.where(F.col(key).isNotNull()).join(first, key)
    fresh = keyed.where(F.col("source_rank") == F.col("_first")).select(*tagged.columns)
    unkeyed = tagged.where(F.col(key).isNull())
    if null_mode == "safe":
        return fresh.unionByName(unkeyed)
    if null_mode != "sql":
        raise ValueError(f"unknown null_mode {null_mode!r}")
    target_nulls = known.select(F.count_if(F.col(key).isNull())).scalar()
    target_rows = known.select(F.count("*")).scalar()
    head = tagged.select(F.min("source_rank")).scalar()
    # The first non-empty source fills an empty target whole; a NULL key it brings shuts out the rest.
    null_ranks = tagged.where(F.col(key).isNull()).select(F.min("source_rank")).scalar()
    shut = (target_rows == 0) & F.coalesce(null_ranks == head, F.lit(False))
    admit = (target_nulls == 0) & (~shut | (F.col("source_rank") == head))
    return fresh.where(admit).unionByName(
        unkeyed.where((target_rows == 0) & (F.col("source_rank") == head))
    )


def assign_ids(
    fresh: DataFrame, target: DataFrame, order: Sequence[str], id_col: str = "id"
) -> DataFrame:
    """Number new rows after the largest id in target, in insertion order."""
    top = target.select(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    numbered = number_rows(fresh, list(order), out="_seq")
    keep = [c for c in fresh.columns if c != id_col]
    return numbered.select((top + F.col("_seq")).cast("bigint").alias(id_col), *keep)

"""Bounded samples of labelled rows for fitting, and the hash splits that keep rows out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bellwire.session import broadcast_if_small


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def carried(docs: DataFrame, columns: list[str]) -> tuple[list[Column], str]:
    """Columns to carry through a function in Arrow, under names of their own, and their part of its schema."""
    fields = docs.select(*[F.col(f"`{c}`") for c in columns]).schema.fields
    return [F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(columns)], "".join(f", _x{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))


def restored(columns: list[str]) -> list[Column]:
    return [F.col(f"_x{i}").alias(c) for i, c in enumerate(columns)]


def sample_ids(labelled: DataFrame, label: str, per_label: int, most_labels: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the ``per_label`` rows of each label with the smallest hash, for all labels or those with most rows.

    The count of a label bounds how small those hashes are, so about four times ``per_label`` narrow
    rows per label are ranked, whatever the size of the table or the share of one label.
    """
    span = 1 << 30
    drawn = F.pmod(F.xxhash64(F.col(id_col)), F.lit(span))
    labels = labelled.groupBy(label).count()
    if most_labels is not None:
        labels = labels.orderBy(F.desc("count"), label).limit(most_labels)
    labels = labels.select(label, (F.lit(4.0 * per_label * span) / F.col("count")).alias("_limit"))
    near = labelled.join(broadcast_if_small(labels), label).where(drawn <= F.col("_limit"))
    few = near.withColumn("_nth", F.row_number().over(W.partitionBy(label).orderBy(drawn, id_col))).where(f"_nth <= {per_label}")
    return few.select(id_col, label).dropDuplicates([id_col])

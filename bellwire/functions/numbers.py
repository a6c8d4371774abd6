"""Tolerant numbers: text that is no number, and NaN, both become NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(col: Column) -> Column:
    """NaN sorts above every number and poisons averages in Spark, so it is stored as NULL."""
    return F.nanvl(col, F.lit(None).cast("double"))


def numeric(col: Column | str) -> Column:
    """Coerce to DOUBLE; anything that is not a finite or infinite number is NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return nan_to_null(col.try_cast("double"))


def integer_id(col: Column | str) -> Column:
    """Coerce an id to BIGINT; junk is NULL. ``"7.0"`` is 7, as in a float-typed id column."""
    col = F.col(col) if isinstance(col, str) else col
    value = numeric(col)
    return F.coalesce(col.try_cast("bigint"), F.when(value == F.floor(value), value.try_cast("bigint")))


def ratio(num: Column, den: Column) -> Column:
    """Division that is NULL for a zero denominator."""
    return F.try_divide(num, den)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def sigmoid(col: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col))


def relu(col: Column) -> Column:
    return F.greatest(F.lit(0.0), col)

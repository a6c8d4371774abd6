"""Joins of many rows with a lookup table: broadcast while it is counted small, salted for hot keys beyond."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows counts as hot; at most 1 / SHARE keys can be.
SHARE = 0.005
#: Tasks over which the rows of a hot key are spread, and copies made of its lookup rows.
SPREAD = 64


def hot_keys(rows: DataFrame, key: str, share: float = SHARE) -> list:
    """Every key value with more than ``share`` of the rows, and perhaps some rarer ones; at most 1 / share values.

    Found by a frequent-items sketch of that bounded size, merged over the tasks in one pass without a shuffle of the rows.
    """
    found = rows.select(key).na.drop().stat.freqItems([key], support=share).first()
    return sorted(v for v in (found[0] or []) if v is not None)


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    lookup_key: str,
    spread_by: Sequence[str],
    how: str = "left",
    share: float = SHARE,
    spread: int = SPREAD,
) -> DataFrame:
    """Shuffled equality join in which no key keeps all its rows in one task.

    Rows of hot keys get a salt, a hash of ``spread_by``, and the lookup rows of these keys, a bounded number of keys,
    are copied once per salt; all other keys have salt 0. Every row meets each of its lookup rows once, so the
    result is that of the plain join, for inner, left, semi and anti joins. NULL keys meet nothing and are salted too.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how!r}")
    hot = hot_keys(rows, key, share)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(spread)).cast("int")
    salted = rows.withColumn("_salt", F.when(F.col(key).isNull() | F.col(key).isin(hot), salt).otherwise(0))
    copies = F.when(F.col(lookup_key).isin(hot), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    copied = lookup.withColumn("_lookup_salt", F.explode(copies))
    match = (F.col(key) == F.col(lookup_key)) & (F.col("_salt") == F.col("_lookup_salt"))
    return salted.join(copied, match, how).drop("_salt", "_lookup_salt")

"""Headline preparation from raw table to numbered, clean, pre-market headlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwire.functions.text import clean_title, is_valid_title
from bellwire.functions.timez import canonical_text, parse_utc
from bellwire.operators.dedup import keep_first
from bellwire.operators.sequence import reindex_by_column
from bellwire.operators.sessions import keep_pre_market


def prepare_headlines(
    news: DataFrame,
    calendar: DataFrame,
    dedup_keys: Sequence[str] = ("title",),
    order_by: str = "published_at",
    strict_weekdays: bool = False,
) -> DataFrame:
    """Keep pre-market headlines, normalise time, keep the first of equal keys, clean and check titles,
    and number the rest 1..N by ``order_by``.

    One shuffle for the duplicates and one range exchange for the numbering; the time is parsed once
    and the title is cleaned only on rows that survive.
    """
    timed = news.withColumn("_utc", parse_utc("published_at"))
    kept = keep_pre_market(timed, F.col("_utc"), calendar, strict_weekdays)
    standard = kept.withColumn(
        "published_at", F.coalesce(canonical_text(F.col("_utc")), F.col("published_at"))
    ).drop("_utc")
    first = keep_first(standard, list(dedup_keys))
    # Range partitioning reads its input twice, so the costly cleaning comes after it.
    numbered = reindex_by_column(first.where(is_valid_title("title")), order_by)
    return numbered.withColumn("title_clean", clean_title("title"))

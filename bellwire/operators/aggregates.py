"""Per-day and per-group aggregates: day sentiment, bags of values, pooled vectors, softmax."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bellwire.functions.numbers import numeric, ratio
from bellwire.functions.replies import source_column
from bellwire.functions.vectors import l2_norm
from bellwire.operators.sequence import number_rows
from bellwire.operators.sessions import session_gap_join
from bellwire.session import broadcast_if_small, materialise


def distinct_sources(scored: DataFrame, source: str = "source") -> DataFrame:
    return scored.select(source).where(F.col(source).isNotNull()).distinct()


def daily_partials(
    matched: DataFrame, scores: Sequence[str], day: str = "trade_date", source: str = "source"
) -> DataFrame:
    """Sum and count per day and source for every score column: the one pass over the headlines.

    Everything after it works on days x sources rows. A hot day or source is combined map-side.
    """
    aggs = [
        agg
        for s in scores
        for agg in (
            F.sum(numeric(s)).alias(f"_sum_{s}"),
            F.count(numeric(s)).alias(f"_cnt_{s}"),
        )
    ]
    return matched.groupBy(day, source).agg(*aggs)


def scored_sources(scored: DataFrame, scores: Sequence[str], source: str = "source") -> dict[str, list[str]]:
    """For each score column, the sources that have a row with that score; one row per source is collected.

    A stored text counts as a score even if it is no number; NaN counts as NULL.
    """
    real = [s for s, kind in scored.select(*scores).dtypes if kind in ("double", "float")]
    set_rows = [F.count(numeric(s) if s in real else F.col(s)).alias(s) for s in scores]
    counts = scored.where(F.col(source).isNotNull()).groupBy(source).agg(*set_rows)
    rows = counts.orderBy(source).collect()
    return {s: [r[source] for r in rows if r[s]] for s in scores}


def daily_columns(
    partials: DataFrame,
    labels: dict[str, str],
    sources: Sequence[str] | dict[str, list[str]] = (),
    day: str = "trade_date",
    source: str = "source",
) -> DataFrame:
    """Means per day, and per day and source as columns, from the partial sums.

    ``labels`` maps score column to output column; ``sources`` is one list for all scores or a list
    per score. Sources whose column names coincide share that column. Rows with a NULL source count
    in the day mean.
    """
    out: list[Column] = []
    for score, base in labels.items():
        total, n = F.col(f"_sum_{score}"), F.col(f"_cnt_{score}")
        out.append(ratio(F.sum(total), F.sum(n)).alias(base))
        named: dict[str, list[str]] = {}
        for s in sources[score] if isinstance(sources, dict) else sources:
            named.setdefault(source_column(base, s), []).append(s)
        for name, same in named.items():
            mine = F.col(source).isin(same)
            out.append(ratio(F.sum(F.when(mine, total)), F.sum(F.when(mine, n))).alias(name))
    return partials.groupBy(day).agg(*out)


def aggregate_daily(
    prices: DataFrame,
    news: DataFrame,
    at: Column,
    labels: dict[str, str],
    sources: Sequence[str] | None = None,
    by_source: bool = True,
) -> DataFrame:
    """Attach mean sentiment of the gap before each open, for all score columns in one join.

    ``sources=None`` takes, for each score, the sources of the rows that have that score, matched or
    not; a source without a match then has a column of NULLs.
    """
    matched = session_gap_join(news, at, prices)
    partials = daily_partials(matched, list(labels))
    if by_source and sources is None:
        sources = scored_sources(news, list(labels))
    daily = daily_columns(partials, labels, sources or ())
    return prices.join(daily, "trade_date", "left")


def group_means(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.avg(numeric(c)).alias(c) for c in columns])


def bag_by_group(
    df: DataFrame, group: str, id_col: str, value: Column | str, max_items: int = 10_000
) -> DataFrame:
    """Values of each group as lists in id order, cut into chunks of at most ``max_items``.

    A group with a large share of the rows would not fit one list, so rows get a global position
    in (group, id) order and every ``max_items`` positions of a group form one chunk.
    """
    item = F.col(value) if isinstance(value, str) else value
    seq = number_rows(df.select(group, id_col, item.alias("_v")), [group, id_col], out="_pos")
    starts = seq.groupBy(F.col(group).alias("_g")).agg(F.min("_pos").alias("_start"))
    placed = seq.join(broadcast_if_small(starts), F.col(group).eqNullSafe(F.col("_g")))
    chunk = F.floor((F.col("_pos") - F.col("_start")) / F.lit(max_items)).cast("bigint")
    items = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col("_v").alias("value"))))
    return placed.groupBy(group, chunk.alias("chunk")).agg(F.count("*").alias("n_items"), items.alias("items"))


def pool_vectors(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Element-wise mean, max and min per group.

    The summariser keeps one running vector per task and group, so no row is exploded per element.
    """
    v = array_to_vector(F.col(vec))
    stats = df.where(F.col(vec).isNotNull()).groupBy(group).agg(
        Summarizer.metrics("mean", "max", "min").summary(v).alias("_s")
    )
    return stats.select(
        group,
        *[vector_to_array(F.col(f"_s.{m}")).alias(f"vec_{m}") for m in ("mean", "max", "min")],
    )


def top_norms(df: DataFrame, group: str, id_col: str, vec: str, n: int = 3) -> DataFrame:
    """The n largest L2 norms per group, ascending, padded with 0.0 in front.

    The rank limit applies inside every map task first, so a hot group sends n rows per task.
    """
    norms = df.where(F.col(vec).isNotNull()).select(group, id_col, l2_norm(F.col(vec)).alias("_norm"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.col("_norm").desc(), F.col(id_col)))
    top = norms.withColumn("_rn", rank).where(F.col("_rn") <= n)
    kept = F.array_sort(F.collect_list("_norm"))
    padded = F.concat(F.array_repeat(F.lit(0.0), F.lit(n) - F.size(kept)), kept)
    return top.groupBy(group).agg(padded.alias("top_norms"))


def _softmax_state(rows: DataFrame, group: str, score: str) -> DataFrame:
    """(_g, _top, _z) per group: the largest score, and the sum of exp(score - largest).

    One pass over the rows makes a state (largest, scaled sum) per group and batch; only those are shuffled, and a
    group's states are brought to its overall maximum before they are added.
    """
    schema = rows.select(F.col(group).alias("_g"), F.col(score).alias("_m"), F.col(score).alias("_z")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(0).dictionary_encode("encode")
                at, value = keys.indices.to_numpy(), batch.column(1).to_numpy()
                top = np.full(len(keys.dictionary), -np.inf)
                np.maximum.at(top, at, value)
                # Equal infinities weigh the same, as equal scores do.
                sums = np.bincount(at, np.exp(np.where(value == top[at], 0.0, value - top[at])), len(top))
                yield pa.RecordBatch.from_arrays([keys.dictionary.cast(batch.schema.field(0).type), pa.array(top), pa.array(sums)], names=["_g", "_m", "_z"])

    states = materialise(rows.select(F.col(group).alias("_g"), F.col(score).alias("_m")).mapInArrow(run, schema), "softmax-states")
    tops = states.groupBy("_g").agg(F.max("_m").alias("_top"))
    scaled = F.when(F.col("_m") == F.col("_top"), F.col("_z")).otherwise(F.col("_z") * F.exp(F.col("_m") - F.col("_top")))
    joined = states.join(tops.withColumnRenamed("_g", "_k"), F.col("_g").eqNullSafe(F.col("_k")))
    return joined.groupBy("_g").agg(F.first("_top").alias("_top"), F.sum(scaled).alias("_z"))


def softmax_weights(df: DataFrame, group: str, score: str, out: str = "weight") -> DataFrame:
    """Softmax of ``score`` within each group, shifted by the group maximum.

    The rows are read twice: for the group states, and to be joined with them. No group is gathered in one
    task. Rows whose score is NULL or NaN, or whose group is NULL, take no part.
    """
    rows = df.withColumn(score, numeric(score)).where(F.col(score).isNotNull() & F.col(group).isNotNull())
    state = broadcast_if_small(_softmax_state(rows, group, score))
    shifted = F.when(F.col(score) == F.col("_top"), 1.0).otherwise(F.exp(F.col(score) - F.col("_top")))
    return rows.join(state, F.col(group) == F.col("_g")).withColumn(out, shifted / F.col("_z")).drop("_g", "_top", "_z")


def attention_pool(df: DataFrame, group: str, score: str, vec: str) -> DataFrame:
    """Softmax-weighted mean vector per group: sum of exp-weighted elements over sum of weights.

    Only present rows take part; there is no padding to attract weight.
    """
    rows = df.withColumn(score, numeric(score)).where(F.col(score).isNotNull() & F.col(vec).isNotNull())
    tops = broadcast_if_small(
        materialise(rows.groupBy(F.col(group).alias("_g")).agg(F.max(score).alias("_top")), "attention-max")
    )
    weighted = rows.join(tops, F.col(group) == F.col("_g")).select(
        group,
        F.exp(F.col(score) - F.col("_top")).alias("_w"),
        array_to_vector(F.col(vec)).alias("_vec"),
    )
    stats = weighted.groupBy(group).agg(Summarizer.metrics("mean").summary(F.col("_vec"), F.col("_w")).alias("_s"))
    return stats.select(group, vector_to_array(F.col("_s.mean")).alias("pooled"))


def expanding_stats(
    df: DataFrame, value: str, date_col: str = "trade_date", symbol: str | None = None
) -> DataFrame:
    """Count, mean and population std of all earlier days of the series, today left out."""
    base = W.partitionBy(symbol) if symbol else W.partitionBy()
    earlier = base.orderBy(date_col).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumns(
        {
            "n_before": F.count(value).over(earlier),
            "mean_before": F.avg(value).over(earlier),
            "std_before": F.stddev_pop(value).over(earlier),
        }
    )

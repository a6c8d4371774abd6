"""Models on whole days of headline vectors: pooled embeddings, attention pooling, lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwire.functions.vectors import linear, relu_all
from bellwire.operators.aggregates import attention_pool, group_means, pool_vectors, top_norms
from bellwire.operators.features import fit_scaling, lag_names, lag_returns_from_prices, split_by_dates
from bellwire.operators.maintenance import drop_incomplete
from bellwire.operators.sessions import join_same_date
from bellwire.plans.models import LABEL, SEED, WEIGHT, fit_rows_model
from bellwire.session import materialise


def spread(df: DataFrame, vec: str, prefix: str, width: int) -> DataFrame:
    """One column per element of a fixed-width vector."""
    return df.withColumns({f"{prefix}{i}": F.col(vec)[i] for i in range(width)}).drop(vec)


def pooled_day_features(
    rows: DataFrame, day: str, id_col: str, vec: str, sentiment: Sequence[str], width: int, n_top: int = 3
) -> tuple[DataFrame, list[str]]:
    """Per day: element-wise mean, max and min, the largest norms, and mean sentiment."""
    pooled = pool_vectors(rows, day, vec)
    norms = top_norms(rows, day, id_col, vec, n_top)
    means = group_means(rows, day, sentiment)
    daily = pooled.join(norms, day).join(means, day)
    for col, prefix, size in (
        ("vec_mean", "mean_", width),
        ("vec_max", "max_", width),
        ("vec_min", "min_", width),
        ("top_norms", "norm_", n_top),
    ):
        daily = spread(daily, col, prefix, size)
    return daily, [c for c in daily.columns if c != day]


def day_model_frame(
    prices: DataFrame, daily: DataFrame, names: Sequence[str], n_lags: int = 3, lag_before_drop: bool = True
) -> tuple[DataFrame, list[str]]:
    """Prices with day features and lagged returns, incomplete days dropped.

    Lags follow the trading calendar; ``lag_before_drop=False`` takes them over days with news only.
    """
    base = prices.join(daily, "trade_date", "left")
    if lag_before_drop:
        base = drop_incomplete(lag_returns_from_prices(base, n_lags), names)
    else:
        base = lag_returns_from_prices(drop_incomplete(base, names), n_lags)
    lags = [f"lag_{k}" for k in range(1, n_lags + 1)]
    base = base.withColumnsRenamed(dict(zip(lag_names(n_lags), lags)))
    features = [*names, *lags]
    return drop_incomplete(base, lags).select("trade_date", LABEL, *features), features


def embedding_forest(
    news: DataFrame,
    at: Column,
    prices: DataFrame,
    vec: str,
    sentiment: Sequence[str],
    width: int,
    train: tuple[str, str],
    test: tuple[str, str],
    id_col: str = "id",
    n_top: int = 3,
    n_lags: int = 3,
    trees: int = 100,
) -> DataFrame:
    """Forest on pooled embeddings, day sentiment and lags; returns the test predictions."""
    matched = join_same_date(news, at, prices.select("trade_date"))
    daily, names = pooled_day_features(matched, "trade_date", id_col, vec, sentiment, width, n_top)
    frame, features = day_model_frame(prices, daily, names, n_lags)
    frame = materialise(split_by_dates(frame, train, test), "day-frame")
    scaled = fit_scaling(frame, features, F.col("split") == "train").transform(frame)
    model = fit_rows_model(
        scaled.where("split = 'train'"),
        features,
        lambda _: RandomForestClassifier(
            labelCol=LABEL, weightCol=WEIGHT, numTrees=trees, maxDepth=30, featureSubsetStrategy="sqrt", seed=SEED
        ),
    )
    return predictions(model, scaled.where("split = 'test'"), features)


def predictions(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    named = rows.withColumns({f"f{i}": F.col(n).cast("double") for i, n in enumerate(features)})
    proba = vector_to_array(F.col("probability"))[1]
    return model.transform(named).select(
        "trade_date",
        F.col(LABEL).alias("actual_increase"),
        proba.alias("predicted_proba"),
        F.when(proba >= 0.5, 1).otherwise(0).alias("predicted_label"),
    )


def attention_day_features(
    rows: DataFrame,
    day: str,
    vec: str,
    sentiment: Sequence[str],
    width: int,
    projection: Sequence[Sequence[float]],
    projection_bias: Sequence[float],
    text_score: Column,
    sentiment_score: Column,
) -> tuple[DataFrame, list[str]]:
    """Per day: attention-pooled text vector, and attention-pooled projected sentiment.

    Text and sentiment have their own softmax. ``text_score`` and ``sentiment_score`` (which may
    read ``_sent``, the projected sentiment) are given scoring expressions.
    """
    raw = F.array(*[F.col(s).cast("double") for s in sentiment])
    base = rows.withColumn("_sent", relu_all(linear(raw, projection, projection_bias)))
    base = base.withColumns({"_ts": text_score, "_ss": sentiment_score})
    text = spread(attention_pool(base, day, "_ts", vec), "pooled", "text_", width)
    sent = spread(attention_pool(base, day, "_ss", "_sent"), "pooled", "sent_", len(projection))
    daily = text.join(sent, day)
    return daily, [c for c in daily.columns if c != day]

"""Model fits over the long daily series made from orders."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from bellwire import fixtures as fx
from bellwire.fixtures import PRIORITIES
from bellwire.functions.replies import source_column
from bellwire.functions.vectors import dot
from bellwire.operators import features as ft
from bellwire.operators import maintenance as mt
from bellwire.operators.sessions import join_same_date
from bellwire.operators.stats import classification_report
from bellwire.plans import day_vectors as dv
from bellwire.plans import experiments as ex
from bellwire.plans import models as ml
from bellwire.registry.base import entry, plain
from bellwire.session import materialise
from bellwire.sources import tables as tb

_DATES = {"train": ("1995-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}
_SOURCES = PRIORITIES


def _market(spark, sf):
    return materialise(fx.market(spark, sf), "market")


def _sentiment(variant):
    if variant == "sources":
        return [source_column("avg_sentiment", s) for s in _SOURCES]
    return ["avg_sentiment"] if variant == "consolidated" else []


def _fit(spark, sf, family, variant):
    return ml.fit_family(_market(spark, sf), family, variant, _sentiment(variant), **_DATES)


def _checked(preds):
    """The exact part of predictions: days, labels, and whether probabilities and labels agree."""
    proba = F.col("predicted_proba")
    return plain(
        preds.select(
            "trade_date",
            F.col("actual_increase").cast("int").alias("actual_increase"),
            F.coalesce(proba.between(0, 1), F.lit(False)).alias("proba_in_range"),
            (F.col("predicted_label") == (proba >= 0.5).cast("int")).alias("label_follows"),
        )
    )


def _predictions(family, variant):
    return lambda spark, sf: _checked(_fit(spark, sf, family, variant).predict())


def ts_grid_search(spark, sf):
    return _fit(spark, sf, "lr", "baseline").search


def coefficients(spark, sf):
    return _fit(spark, sf, "lr", "consolidated").weights()


def top_importances(spark, sf):
    return _fit(spark, sf, "rf", "sources").top_importances(10)


def model_report(spark, sf):
    preds = _fit(spark, sf, "lr", "sources").predict()
    return classification_report(preds, "actual_increase", "predicted_label")


def predictions_csv(spark, sf):
    fitted = _fit(spark, sf, "lr", "baseline")
    path = fitted.save_predictions(ml.artefact_path(spark, "lr", "baseline", "returns", "predictions"))
    return _checked(tb.read_csv(spark, path, fitted.predict().schema))


def model_roundtrip(spark, sf):
    """The reloaded pipeline on unscaled feature rows against the model in memory."""
    fitted = _fit(spark, sf, "lr", "baseline")
    path = fitted.save(ml.artefact_path(spark, "lr", "baseline", "returns", "model"))
    rows = fitted.frame.where("split = 'test'").select("trade_date", *[F.col(f"`{n}`") for n in fitted.features])
    theirs = ml.load_model(path).transform(rows).select("trade_date", vector_to_array("probability")[1].alias("reloaded"))
    both = fitted.predict().join(theirs, "trade_date")
    return plain(both.select("trade_date", F.abs(F.col("predicted_proba") - F.col("reloaded")).alias("difference")))


def model_roundtrip_raw(spark, sf):
    """The reloaded artefact on raw daily rows, some without sentiment, against the model in memory on its features."""
    gap = F.dayofmonth("trade_date") % 7 == 0
    daily = materialise(fx.market(spark, sf).withColumn("avg_sentiment", F.when(~gap, F.col("avg_sentiment"))), "gaps")
    fitted = ml.fit_family(daily, "gbt", "consolidated", ["avg_sentiment"], **_DATES)
    path = fitted.save_whole(ml.artefact_path(spark, "gbt", "consolidated", "gaps", "whole"))
    theirs = ml.load_model(path).transform(daily).select("trade_date", vector_to_array("probability")[1].alias("reloaded"))
    both = fitted.predict().join(theirs, "trade_date")
    return plain(both.select("trade_date", F.abs(F.col("predicted_proba") - F.col("reloaded")).alias("difference")))


def experiment_matrix(spark, sf):
    """Every family, variant and scorer at the full grids; powers of the sentiment stand in for the scorers."""
    daily = _market(spark, sf)
    bases = [c for c in daily.columns if c.startswith("avg_sentiment")]
    scores = {c.replace("avg_sentiment", s): F.pow(c, F.lit(float(k))) for k, s in enumerate(ex.SCORERS.values(), 1) for c in bases}
    daily = materialise(daily.withColumns(scores), "scorers")
    return ex.run_matrix(daily, ex.matrix(), _SOURCES, **_DATES)


def walk_forward(spark, sf):
    """Refit at each day of the test span, trained on everything before."""
    spec = ft.FeatureSpec(n_lags=3, with_interactions=False, **_DATES)
    frame, names = ft.feature_frame(_market(spark, sf), spec)
    frame = materialise(frame, "walk")
    return plain(ml.walk_forward_logistic(frame, names, "1995-01-01", "2000-01-01", "2001-12-31"))


def _vector_news(spark, sf):
    """Every embedding as a headline of some order day, with a sentiment from its label."""
    days = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", F.col("o_totalprice").alias("price"))
    n = fx.table(spark, sf, "embeddings").select(F.count("*")).scalar()
    vectors = fx.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    keyed = days.withColumn("vec_id", F.col("id") % n)
    return keyed.join(vectors, "vec_id").select(
        "id", "embedding", F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), (F.col("price") / 500000).alias("sentiment")
    )


def _returns(spark, sf):
    return _market(spark, sf).select("trade_date", "open_price", "close_price", ml.LABEL)


def embedding_forest(spark, sf):
    out = dv.embedding_forest(
        _vector_news(spark, sf), F.col("ts"), _returns(spark, sf), "embedding", ["sentiment"], 64,
        _DATES["train"], _DATES["test"],
    )
    return plain(out)


def attention_classifier(spark, sf):
    """Attention-pooled day vectors and lags into a network, refitted at each test day."""
    prices = _returns(spark, sf)
    rows = join_same_date(_vector_news(spark, sf), F.col("ts"), prices.select("trade_date"))
    rows = mt.drop_incomplete(rows, ["embedding", "sentiment"])
    weights = F.array(*[F.lit((i % 5 - 2) / 2) for i in range(64)])
    daily, names = dv.attention_day_features(
        rows, "trade_date", "embedding", ["sentiment"], 64, [[1.0], [-1.0]], [0.0, 0.5],
        dot(F.col("embedding"), weights), F.col("_sent")[0] * 2,
    )
    frame, features = dv.day_model_frame(prices, daily, names)
    frame = materialise(frame, "attention")
    return plain(ml.walk_forward_network(frame, features, "1995-01-01", "2000-01-01", "2001-12-31"))


# Test days of a fit: rows with a label and a return, less the first three, which have no full lags.
_TEST_DAYS = f"""
  select * from (select *, row_number() over (order by trade_date) as nth from fx_market
                 where increase is not null and daily_return is not null)
  where nth > 3 and trade_date between date '{_DATES["test"][0]}' and date '{_DATES["test"][1]}'"""
_CHECKED_SQL = f"""
  select cast(trade_date as varchar) as trade_date, increase as actual_increase, true as proba_in_range,
         true as label_follows from ({_TEST_DAYS})"""

ENTRIES = {
    **{f"{f}_{v}": entry(_predictions(f, v), _CHECKED_SQL) for f in ("lr", "rf", "gbt") for v in ("baseline", "consolidated", "sources")},
    "ts_grid_search": entry(ts_grid_search),
    "coefficients": entry(coefficients),
    "top_importances": entry(top_importances),
    "model_report": entry(model_report),
    "predictions_csv": entry(predictions_csv, _CHECKED_SQL),
    "model_roundtrip": entry(model_roundtrip, f"select cast(trade_date as varchar) as trade_date, 0.0::double as difference from ({_TEST_DAYS})"),
    # Lags that are missing are imputed in this variant, so every test day with a label has a row.
    "model_roundtrip_raw": entry(
        model_roundtrip_raw,
        f"""select cast(trade_date as varchar) as trade_date, 0.0::double as difference from fx_market
            where increase is not null and trade_date between date '{_DATES["test"][0]}' and date '{_DATES["test"][1]}'""",
    ),
    "experiment_matrix": entry(experiment_matrix),
    "walk_forward": entry(walk_forward),
    "embedding_forest": entry(embedding_forest),
    "attention_classifier": entry(attention_classifier),
}

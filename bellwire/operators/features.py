"""Model features over the daily table: lags, interactions, imputation, scaling, splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwire.functions.numbers import numeric, ratio
from bellwire.functions.replies import source_column
from bellwire.operators.maintenance import require_columns
from bellwire.sources.prices import series_window


def lag_names(n: int) -> list[str]:
    return [f"prev_return_t-{k}" for k in range(1, n + 1)]


def lag_returns(df: DataFrame, n: int, symbol: str | None = None) -> DataFrame:
    """``prev_return_t-k`` = the daily return k trading days earlier."""
    w = series_window(symbol)
    return df.withColumns({name: F.lag("daily_return", k).over(w) for k, name in enumerate(lag_names(n), 1)})


def lag_returns_from_prices(df: DataFrame, n: int, symbol: str | None = None) -> DataFrame:
    """The same lags computed from lagged open and close prices."""
    w = series_window(symbol)
    opened, closed = numeric("open_price"), numeric("close_price")
    return df.withColumns(
        {
            name: ratio(F.lag(closed, k).over(w) - F.lag(opened, k).over(w), F.lag(opened, k).over(w))
            for k, name in enumerate(lag_names(n), 1)
        }
    )


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def interactions(df: DataFrame, sentiment: Sequence[str], lags: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Products sentiment x lag and lag_i x lag_j (i < j), named ``a*b``."""
    pairs = [(s, r) for s in sentiment for r in lags] + list(combinations(lags, 2))
    products = {f"{a}*{b}": _q(a) * _q(b) for a, b in pairs}
    return df.withColumns(products), list(products)


def select_source_columns(columns: Sequence[str], base: str, sources: Sequence[str]) -> list[str]:
    """Per-source sentiment columns that exist, in source order; an error when there is none."""
    found = [c for s in sources for c in dict.fromkeys([f"{base}_{s}", source_column(base, s)]) if c in columns]
    if not found:
        raise ValueError(f"no {base} columns for sources {list(sources)}")
    return found


def split_by_dates(
    df: DataFrame,
    train: tuple[str | date, str | date],
    test: tuple[str | date, str | date],
    date_col: str = "trade_date",
) -> DataFrame:
    """Add ``split`` = train/test by inclusive date bounds; other rows are NULL."""
    day = F.col(date_col)

    def inside(bounds):
        return day.between(F.lit(bounds[0]).cast("date"), F.lit(bounds[1]).cast("date"))

    return df.withColumn("split", F.when(inside(train), "train").when(inside(test), "test"))


@dataclass(frozen=True)
class Imputation:
    """Column means learnt from a frame."""

    means: dict[str, float | None]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: F.coalesce(numeric(_q(c)), F.lit(m).cast("double")) for c, m in self.means.items()}
        )


def fit_imputation(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> Imputation:
    """Means of ``columns`` over the rows of ``where`` (the train rows), or over all rows."""
    rows = df if where is None else df.where(where)
    first = rows.agg(*[F.avg(numeric(_q(c))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return Imputation({c: first[i] for i, c in enumerate(columns)})


@dataclass(frozen=True)
class Scaling:
    """Mean and population standard deviation per column; a constant column is only centred."""

    stats: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (_q(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()})


def fit_scaling(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> Scaling:
    rows = df if where is None else df.where(where)
    aggs = [
        a
        for i, c in enumerate(columns)
        for a in (F.avg(_q(c)).alias(f"m{i}"), F.stddev_pop(_q(c)).alias(f"s{i}"))
    ]
    first = rows.agg(*aggs).first()
    if any(first[f"m{i}"] is None for i in range(len(columns))):
        raise ValueError("no rows to fit the scaling on")
    return Scaling({c: (first[f"m{i}"], first[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


@dataclass(frozen=True)
class FeatureSpec:
    """What goes into a model frame.

    ``lags_from`` is "returns" or "prices"; ``lag_nulls`` says whether the first rows, which have
    no full lags, are dropped or imputed; ``impute_scope`` is "train" or "all".
    """

    sentiment: tuple[str, ...] = ()
    n_lags: int = 3
    lags_from: str = "returns"
    with_interactions: bool = True
    lag_nulls: str = "drop"
    impute_scope: str = "train"
    train: tuple[str, str] = ("2018-01-01", "2022-12-31")
    test: tuple[str, str] = ("2023-01-01", "2023-12-31")


def feature_frame(daily: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, list[str]]:
    """Model rows with ``trade_date``, ``increase``, ``split`` and the feature columns, and their names."""
    frame, names, _ = fit_feature_frame(daily, spec)
    return frame, names


def fit_feature_frame(daily: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, list[str], Imputation]:
    """``feature_frame`` with the means it learnt for missing values."""
    need = ["trade_date", "increase", *spec.sentiment]
    need += ["daily_return"] if spec.lags_from == "returns" else ["open_price", "close_price"]
    df = require_columns(daily, need).where(F.col("increase").isNotNull())
    if spec.lags_from == "returns":
        df = lag_returns(df.where(F.col("daily_return").isNotNull()), spec.n_lags)
    else:
        df = lag_returns_from_prices(df, spec.n_lags)
    lags = lag_names(spec.n_lags)
    df = split_by_dates(df, spec.train, spec.test)
    fill = list(spec.sentiment) + (lags if spec.lag_nulls == "impute" else [])
    if spec.lag_nulls == "drop":
        df = df.na.drop(subset=lags)
    imputation = Imputation({})
    if fill:
        scope = F.col("split") == "train" if spec.impute_scope == "train" else None
        imputation = fit_imputation(df, fill, scope)
        df = imputation.transform(df)
    names = [*spec.sentiment, *lags]
    if spec.with_interactions:
        df, added = interactions(df, spec.sentiment, lags)
        names += added
    return df.select("trade_date", "increase", "split", *[_q(n) for n in names]), names, imputation

"""Daily prices: typed load, returns, and day-over-day change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwire.functions.numbers import numeric, ratio
from bellwire.operators.dedup import insert_or_ignore

RAW_PRICES = T.StructType(
    [
        T.StructField("Date", T.StringType()),
        T.StructField("Open", T.StringType()),
        T.StructField("Close", T.StringType()),
        T.StructField("High", T.StringType()),
        T.StructField("Low", T.StringType()),
        T.StructField("Volume", T.StringType()),
    ]
)


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """Read a downloaded price CSV into the typed daily table."""
    raw = spark.read.option("header", True).schema(RAW_PRICES).csv(path)
    return raw.select(
        F.col("Date").try_cast("date").alias("trade_date"),
        numeric("Open").alias("open_price"),
        numeric("Close").alias("close_price"),
        numeric("High").alias("high_price"),
        numeric("Low").alias("low_price"),
        numeric("Volume").cast("bigint").alias("volume"),
    )


def add_returns(prices: DataFrame) -> DataFrame:
    """``increase`` and ``daily_return`` of a day; both stay NULL (or as they were) without a return."""
    opened, closed = numeric("open_price"), numeric("close_price")
    ret = ratio(closed - opened, opened)
    old = {c: F.col(c) if c in prices.columns else F.lit(None) for c in ("increase", "daily_return")}
    up = F.when(closed > opened, F.lit(1)).otherwise(F.lit(0))
    return prices.withColumns(
        {
            "increase": F.when(ret.isNotNull(), up).otherwise(old["increase"]).cast("int"),
            "daily_return": F.coalesce(ret, old["daily_return"].cast("double")),
        }
    )


def pct_change_close(prices: DataFrame, symbol: str | None = None) -> DataFrame:
    """Percent change of the close against the previous trading day of the same symbol."""
    prev = F.lag(numeric("close_price")).over(series_window(symbol))
    change = ratio(numeric("close_price") - prev, prev) * 100
    return prices.withColumn("percent_change_close", change)


def series_window(symbol: str | None, date_col: str = "trade_date"):
    """Window over a daily series, one row per trading day, split by symbol where there is one."""
    return (Window.partitionBy(symbol) if symbol else Window.partitionBy()).orderBy(date_col)


def store_prices(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Target plus the batch's new trade dates, with returns filled in."""
    fresh = insert_or_ignore(target, batch, ["trade_date"], "trade_date")
    return add_returns(target.unionByName(fresh, allowMissingColumns=True))

"""Trading calendar, session windows, and the interval joins between headlines and sessions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bellwire.functions.timez import NEW_YORK, at_local_time, is_weekday, to_local
from bellwire.operators.lookup import salted_join
from bellwire.session import BROADCAST_MAX_ROWS, broadcast_if_small

OPEN = (9, 30)
CLOSE = (16, 0)
PRE_MARKET_HOURS = 12


def trading_days(calendar: DataFrame, strict_weekdays: bool = False) -> DataFrame:
    """Distinct trade dates; ``strict_weekdays`` adds every Monday-Friday between first and last."""
    days = calendar.select("trade_date").where(F.col("trade_date").isNotNull()).distinct()
    if not strict_weekdays:
        return days
    weekdays = (
        days.agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
        .where(F.col("lo").isNotNull())
        .select(F.explode(F.sequence("lo", "hi")).alias("trade_date"))
        .where(is_weekday(F.col("trade_date")))
    )
    return days.union(weekdays).distinct()


def pre_market_windows(days: DataFrame, zone: str = NEW_YORK) -> DataFrame:
    """[open - 12h, open) of every trading day, as UTC wall times."""
    opens = at_local_time("trade_date", *OPEN, zone=zone)
    return days.select(
        "trade_date",
        (opens - F.make_dt_interval(F.lit(0), F.lit(PRE_MARKET_HOURS))).alias("window_start"),
        opens.alias("window_end"),
    )


def session_windows(calendar: DataFrame, zone: str = NEW_YORK) -> DataFrame:
    """From the previous trading day's close to this day's open; the first day has none.

    The window function runs over distinct calendar dates only, one row per trading day.
    """
    prev = F.lag("trade_date").over(W.orderBy("trade_date"))
    return (
        trading_days(calendar)
        .withColumn("prev_date", prev)
        .where(F.col("prev_date").isNotNull())
        .select(
            "trade_date",
            "prev_date",
            at_local_time("prev_date", *CLOSE, zone=zone).alias("window_start"),
            at_local_time("trade_date", *OPEN, zone=zone).alias("window_end"),
        )
    )


def _ntz(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def interval_join(
    points: DataFrame,
    at: Column,
    windows: DataFrame,
    how: str = "inner",
    closed_end: bool = True,
    max_broadcast_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Match ``window_start <= at <= window_end`` (``<`` unless ``closed_end``).

    A bare range condition plans as a nested loop over all pairs. Each window is instead listed
    once per UTC date it touches, which gives an equality on the date; the range stays as residual.
    A point has one date, so it meets each window at most once. The windows are counted first: up to
    ``max_broadcast_rows`` they are broadcast, beyond that both sides shuffle on the date.
    """
    by_day = windows.withColumn(
        "_day", F.explode(F.sequence(F.to_date("window_start"), F.to_date("window_end")))
    )
    listed, first, last = by_day.agg(F.count("*"), F.min("window_start"), F.max("window_end")).first()
    if listed and how in ("inner", "left_semi"):
        # Points outside all windows cannot match; on a stored column this prunes the scan.
        points = points.where((at >= _ntz(first)) & (at <= _ntz(last)))
    keyed = points.withColumn("_at", at).withColumn("_at_day", F.to_date("_at"))
    upper = F.col("_at") <= F.col("window_end") if closed_end else F.col("_at") < F.col("window_end")
    match = (F.col("_at_day") == F.col("_day")) & (F.col("_at") >= F.col("window_start")) & upper
    side = F.broadcast(by_day) if listed <= max_broadcast_rows else by_day
    joined = keyed.join(side, match, how)
    return joined.drop("_at", "_at_day", "_day")


def keep_pre_market(
    news: DataFrame, at: Column, calendar: DataFrame, strict_weekdays: bool = False, **kw
) -> DataFrame:
    """Rows published in the 12 hours before the open of some trading day; no time, no row."""
    windows = pre_market_windows(trading_days(calendar, strict_weekdays))
    return interval_join(news, at, windows, how="left_semi", closed_end=False, **kw)


def _session_join(news, at, calendar, strict_weekdays, how, max_broadcast_rows):
    sessions = trading_days(calendar, strict_weekdays).withColumnRenamed("trade_date", "_session_day")
    minute_of_day = F.hour("_local") * 60 + F.minute("_local")
    inside = (minute_of_day >= OPEN[0] * 60 + OPEN[1]) & (minute_of_day < CLOSE[0] * 60 + CLOSE[1])
    match = (F.to_date("_local") == F.col("_session_day")) & inside
    keyed = news.withColumn("_local", to_local(at))
    side = broadcast_if_small(sessions, max_broadcast_rows)
    if side is sessions:
        # Only rows inside the session hours of their day look the day up, spread within a hot day.
        dated = keyed.withColumn("_day", F.when(inside, F.to_date("_local")))
        return salted_join(dated, sessions, "_day", "_session_day", news.columns, how).drop("_local", "_day")
    return keyed.join(side, match, how).drop("_local")


def exclude_market_hours(
    news: DataFrame,
    at: Column,
    calendar: DataFrame,
    strict_weekdays: bool = False,
    max_broadcast_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Drop rows inside 09:30 <= local time < 16:00 of a trading day; unparseable times stay."""
    return _session_join(news, at, calendar, strict_weekdays, "left_anti", max_broadcast_rows)


def only_market_hours(
    news: DataFrame,
    at: Column,
    calendar: DataFrame,
    strict_weekdays: bool = False,
    max_broadcast_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """The rows ``exclude_market_hours`` drops; on its result this must be empty."""
    return _session_join(news, at, calendar, strict_weekdays, "left_semi", max_broadcast_rows)


def session_gap_join(news: DataFrame, at: Column, calendar: DataFrame, **kw) -> DataFrame:
    """Assign each headline to the trading day whose closed gap before the open contains it."""
    windows = session_windows(calendar).select("trade_date", "window_start", "window_end")
    joined = interval_join(news, at, windows, how="inner", closed_end=True, **kw)
    return joined.drop("window_start", "window_end")


def join_same_date(news: DataFrame, at: Column, prices: DataFrame, **kw) -> DataFrame:
    """Inner join on the UTC calendar date of publication."""
    keyed = news.withColumn("trade_date", F.to_date(at))
    return keyed.join(broadcast_if_small(prices, **kw), "trade_date")

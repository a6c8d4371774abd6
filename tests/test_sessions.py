"""Session edges, daylight saving, nested-loop-free plans, and the shuffle fallback."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from bellwire import fixtures as fx
from bellwire.operators import sessions as ss
from bellwire.session import broadcast_if_small


def calendar(spark, *days):
    return spark.createDataFrame([(date.fromisoformat(d),) for d in days], "trade_date date")


def at_new_york(spark, *clocks):
    """Rows whose UTC time is the given New York clock time."""
    rows = spark.createDataFrame([(i, datetime.fromisoformat(c)) for i, c in enumerate(clocks)], "id long, ny timestamp_ntz")
    return rows.withColumn("ts", F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), F.col("ny")))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_regular_session_is_half_open(spark):
    news = at_new_york(spark, "2024-01-03 09:29:59", "2024-01-03 09:30:00", "2024-01-03 15:59:59", "2024-01-03 16:00:00", "2024-01-06 12:00:00")
    days = calendar(spark, "2024-01-03")
    assert ids(ss.exclude_market_hours(news, F.col("ts"), days)) == [0, 3, 4]
    assert ids(ss.only_market_hours(news, F.col("ts"), days)) == [1, 2]


def test_unparseable_time_stays_out_of_pre_market_but_survives_exclusion(spark):
    news = spark.createDataFrame([(1, None)], "id long, ts timestamp_ntz")
    days = calendar(spark, "2024-01-03")
    assert ids(ss.exclude_market_hours(news, F.col("ts"), days)) == [1]
    assert ids(ss.keep_pre_market(news, F.col("ts"), days)) == []


def test_pre_market_window_is_twelve_hours_half_open(spark):
    news = at_new_york(spark, "2024-01-02 21:29:59", "2024-01-02 21:30:00", "2024-01-03 09:29:59", "2024-01-03 09:30:00")
    assert ids(ss.keep_pre_market(news, F.col("ts"), calendar(spark, "2024-01-03"))) == [1, 2]


@pytest.mark.parametrize("monday, sunday", [("2024-03-11", "2024-03-10"), ("2024-11-04", "2024-11-03")])
def test_pre_market_around_clock_changes(spark, monday, sunday):
    news = at_new_york(spark, f"{sunday} 21:29:59", f"{sunday} 21:30:00", f"{monday} 09:29:59", f"{monday} 09:30:00")
    assert ids(ss.keep_pre_market(news, F.col("ts"), calendar(spark, monday))) == [1, 2]


def test_pre_market_on_the_day_of_the_clock_change_counts_elapsed_hours(spark):
    # 12 elapsed hours before 09:30 EDT on the spring Sunday begin at 20:30 EST.
    news = at_new_york(spark, "2024-03-09 20:29:59", "2024-03-09 20:30:00", "2024-03-10 09:29:59")
    assert ids(ss.keep_pre_market(news, F.col("ts"), calendar(spark, "2024-03-10"))) == [1, 2]


def test_gap_is_closed_on_both_ends_and_spans_weekends_and_holidays(spark):
    news = at_new_york(
        spark, "2024-01-05 15:59:59", "2024-01-05 16:00:00", "2024-01-06 12:00:00", "2024-01-08 09:30:00", "2024-01-08 09:30:01",
        "2024-01-12 16:00:00", "2024-01-15 12:00:00", "2024-01-16 09:30:00",
    )
    days = calendar(spark, "2024-01-05", "2024-01-08", "2024-01-12", "2024-01-16")
    got = {r["id"]: str(r["trade_date"]) for r in ss.session_gap_join(news, F.col("ts"), days).collect()}
    assert got == {1: "2024-01-08", 2: "2024-01-08", 3: "2024-01-08", 5: "2024-01-16", 6: "2024-01-16", 7: "2024-01-16"}


def test_gap_join_equals_brute_force(spark, sf_dir):
    news, days = fx.news_large(spark, sf_dir), fx.days(spark, sf_dir)
    windows = ss.session_windows(days)
    brute = news.join(windows, (F.col("ts") >= F.col("window_start")) & (F.col("ts") <= F.col("window_end")))
    fast = ss.session_gap_join(news, F.col("ts"), days)
    assert sorted(map(tuple, fast.select("id", "trade_date").collect())) == sorted(map(tuple, brute.select("id", "trade_date").collect()))


def test_strict_calendar_adds_missing_weekdays(spark):
    days = calendar(spark, "2024-01-05", "2024-01-09")
    got = sorted(str(r[0]) for r in ss.trading_days(days, strict_weekdays=True).collect())
    assert got == ["2024-01-05", "2024-01-08", "2024-01-09"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_interval_joins_never_plan_as_nested_loops(spark, sf_dir):
    news, days = fx.news_large(spark, sf_dir), fx.days(spark, sf_dir)
    for df in (
        ss.keep_pre_market(news, F.col("ts"), days),
        ss.session_gap_join(news, F.col("ts"), days),
        ss.exclude_market_hours(news, F.col("ts"), days),
    ):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text
        assert "BroadcastHashJoin" in text


def test_large_calendar_takes_the_shuffle_join_with_the_same_rows(spark, sf_dir):
    news, days = fx.news_large(spark, sf_dir), fx.days(spark, sf_dir)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = ss.session_gap_join(news, F.col("ts"), days, max_broadcast_rows=5)
        assert "Broadcast" not in plan(shuffled)
        rows = sorted(map(tuple, shuffled.select("id", "trade_date").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    hinted = ss.session_gap_join(news, F.col("ts"), days)
    assert rows == sorted(map(tuple, hinted.select("id", "trade_date").collect()))


def test_broadcast_needs_a_counted_bound(spark):
    assert "isBroadcast" not in str(broadcast_if_small(spark.range(11), 10)._jdf.queryExecution().logical())
    assert "broadcast" in str(broadcast_if_small(spark.range(10), 10)._jdf.queryExecution().logical()).lower()


def test_windows_prune_the_scan(spark, sf_dir):
    """Only points between the first window's start and the last one's end are read on."""
    text = plan(ss.session_gap_join(fx.news_large(spark, sf_dir), F.col("ts"), fx.days(spark, sf_dir)))
    scan = text[text.index("FileScan") :]
    assert "GreaterThanOrEqual(ts" in scan and "LessThanOrEqual(ts" in scan


def test_no_windows_match_nothing(spark):
    news = at_new_york(spark, "2024-01-05 08:00:00")
    assert ids(ss.session_gap_join(news, F.col("ts"), calendar(spark, "2024-01-05"))) == []

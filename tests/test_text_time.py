"""Text cleaning, tokens, time parsing, reply parsing and numbers on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from bellwire.functions import numbers, replies, text, timez

TITLES = [
    None, "", "   ", "Café’s U.S. _x_ 10%", "a\tb\nc", "!!! ???", "😀 up 5%", "étude", "naïve  ÉTÉ", "x y z",
    "  lead and trail 　", "½ off, ²nd ⅷ", "tab\x1cfs\x1d", "Straße 7",
]


def rows(spark, values, col="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, {col} string")


def column(df, expr):
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


def test_clean_title_matches_python_rules(spark):
    def python_clean(t):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t)).strip().lower()

    got = column(rows(spark, TITLES), text.clean_title("t"))
    assert got == [None if t is None else python_clean(t) for t in TITLES]


def test_tokens_match_python_rules(spark):
    got = column(rows(spark, TITLES[1:]), text.tokens("t"))
    assert got == [re.findall(r"\w+", t.lower()) for t in TITLES[1:]]


def test_strip_removes_unicode_blanks(spark):
    assert column(rows(spark, TITLES[1:]), text.strip("t")) == [t.strip() for t in TITLES[1:]]


def test_valid_titles(spark):
    cases = {None: True, "": True, "   ": False, "ok 1": True, "tab\tnl\n": True, "\x1c a": False, "café": False, "?!": False, "a\x0b\x0c\r": True}
    got = column(rows(spark, list(cases)), text.is_valid_title("t"))
    assert got == list(cases.values())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_standardize_parses_each_row_by_itself(spark, zone):
    cases = {
        "2024-01-01T10:00:00Z": "2024-01-01 10:00:00+00:00",
        "2024-01-01 10:00:00+00:00": "2024-01-01 10:00:00+00:00",
        "2024-01-01 10:00:00-05:00": "2024-01-01 15:00:00+00:00",
        "2024-01-01T10:00:00.987Z": "2024-01-01 10:00:00+00:00",
        "junk": "junk", "": "", "12:30": "12:30", None: None,
    }
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = column(rows(spark, list(cases)), timez.standardize_text("t"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == list(cases.values())


def test_text_without_offset_is_utc_and_date_only_is_midnight(spark):
    got = column(rows(spark, ["2024-01-01 10:00:00", "2024-01-01"]), timez.standardize_text("t"))
    assert got == ["2024-01-01 10:00:00+00:00", "2024-01-01 00:00:00+00:00"]


def test_missing_time_becomes_empty_for_ingest(spark):
    assert column(rows(spark, [None, "x", "2024-01-01T00:00:00Z"]), timez.canonical_or_empty("t")) == ["", "", "2024-01-01 00:00:00+00:00"]


def test_local_parts_follow_daylight_saving(spark):
    df = rows(spark, ["2024-03-10T06:59:59Z", "2024-03-10T07:00:00Z", "2024-11-03T05:59:59Z", "2024-11-03T06:00:00Z"])
    assert column(df, timez.local_time(timez.parse_utc("t"))) == ["01:59:59", "03:00:00", "01:59:59", "01:00:00"]


def test_parse_score(spark):
    cases = {
        "0.5": 0.5, "+.5": 0.5, "-1.": -1.0, "1e-3": None, "0.5 ok": None, "": None, " 0.2\n": 0.2, "−0.5": None,
        "3.2": 1.0, "-7": -1.0, ".": None, None: None, "٣": None,
    }
    assert column(rows(spark, list(cases)), replies.parse_score("t")) == list(cases.values())


def test_prompt_fills_null_with_blank(spark):
    got = column(rows(spark, [None, "up {x}"]), replies.format_prompt("t", "market_zero_shot"))
    assert got[0].endswith("News: ") and got[1].endswith("News: up {x}")


def test_names():
    assert replies.score_column("gpt-4.1-mini", "zero_shot") == "llm_sentiment_score_gpt41mini_zero_shot"
    assert replies.source_column("avg_sentiment_lm", "4-NOT SPECIFIED.x") == "avg_sentiment_lm_4_NOT_SPECIFIED_x"


def test_numbers(spark):
    df = rows(spark, ["1.5", "NaN", "abc", None, " 2 ", "7.0", "8"])
    assert column(df, numbers.numeric("t")) == [1.5, None, None, None, 2.0, 7.0, 8.0]
    assert column(df, numbers.integer_id("t")) == [None, None, None, None, 2, 7, 8]


def test_cleaning_is_dealt_evenly_whatever_the_row_groups(spark, tmp_path):
    from bellwire.registry import news

    made = F.concat(*[F.sha2((F.col("id") * 20 + k).cast("string"), 512) for k in range(20)])
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), made.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(2560).cast("long").alias("n_chars"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    clean = news._clean(spark, str(tmp_path)).select("id", "title_clean", F.spark_partition_id().alias("part"))
    found = clean.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).collect()
    assert sum(r.n for r in found) == 4000 and sum(r.ids for r in found) == 4000
    assert len(found) > 2 and max(r.n for r in found) < 3000

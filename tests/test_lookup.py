"""Joins with a lookup table: hot keys spread over tasks, same rows as the plain join, size checks."""

import pytest
from pyspark.sql import functions as F

from bellwire.operators import scoring as sc
from bellwire.operators import sessions as ss
from bellwire.operators.lookup import hot_keys, salted_join
from bellwire.session import broadcast_if_small


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def tokens(spark, n=4000):
    """A third of the rows hold one word, a sixth none; the rest are spread over 300 words."""
    word = F.expr("case when id % 3 = 0 then 'hot' when id % 6 = 1 then null else concat('w', id % 300) end")
    return spark.range(n).withColumn("token", word)


def lookup(spark):
    rows = [("hot", 1), ("hot", 2), *[(f"w{i}", i) for i in range(0, 300, 4)], (None, 7)]
    return spark.createDataFrame(rows, "word string, polarity int")


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_frequent_key_is_found_and_few_others(spark):
    assert "hot" in hot_keys(tokens(spark), "token", 0.1)
    assert len(hot_keys(tokens(spark), "token", 0.1)) <= 10
    assert hot_keys(tokens(spark).limit(0), "token") == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_join(shuffled, how):
    a, b = tokens(shuffled), lookup(shuffled)
    got = salted_join(a, b, "token", "word", ["id"], how, share=0.1, spread=8)
    assert result(got) == result(a.join(b, F.col("token") == F.col("word"), how))
    empty = salted_join(a.limit(0), b, "token", "word", ["id"], how)
    assert result(empty) == [] and empty.columns == got.columns
    alone = salted_join(a, b.limit(0), "token", "word", ["id"], how)
    assert result(alone) == result(a.join(b.limit(0), F.col("token") == F.col("word"), how))


def test_a_hot_key_reaches_many_tasks(shuffled):
    shuffled.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(tokens(shuffled), lookup(shuffled), "token", "word", ["id"], share=0.1, spread=64)
        placed = joined.select("token", "id", F.spark_partition_id().alias("p")).distinct()
        for of_key in (F.col("token") == "hot", F.col("token").isNull()):
            sizes = [r["count"] for r in placed.where(of_key).groupBy("p").count().collect()]
            assert len(sizes) == int(shuffled.conf.get("spark.sql.shuffle.partitions"))
            assert max(sizes) < 0.6 * sum(sizes)
    finally:
        shuffled.conf.set("spark.sql.adaptive.enabled", "true")


def test_an_unsupported_join_is_refused(spark):
    with pytest.raises(ValueError):
        salted_join(tokens(spark), lookup(spark), "token", "word", ["id"], "full")


def test_large_lexicons_take_the_salted_join(shuffled, monkeypatch):
    news = shuffled.range(300).select("id", F.expr("if(id % 50 = 0, null, concat('good good bad w', id % 7, repeat(' good', cast(id % 5 as int))))").alias("title_clean"))
    words = shuffled.createDataFrame([("good", 1), ("bad", -1), ("w3", -1)], "word string, polarity int")
    want = result(sc.score_lexicon(news, words))
    monkeypatch.setattr(sc, "broadcast_if_small", lambda df: df)
    got = sc.score_lexicon(news, words)
    assert result(got) == want
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_session_join_beyond_the_limit_gives_the_same_rows(shuffled):
    days = shuffled.sql("select explode(sequence(date'2024-03-04', date'2024-03-08')) as trade_date")
    news = shuffled.range(500).select("id", F.expr("if(id % 40 = 0, null, timestamp_ntz'2024-03-04 00:00:00' + make_dt_interval(0, 0, cast(id * 17 as int)))").alias("at"))
    for keep in (ss.exclude_market_hours, ss.only_market_hours):
        small = keep(news, F.col("at"), days)
        large = keep(news, F.col("at"), days, max_broadcast_rows=1)
        assert result(large) == result(small) and large.columns == small.columns


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.sequence(F.lit(0), F.lit(99)).alias("v"))
    assert broadcast_if_small(wide, max_bytes=8_000) is wide
    assert broadcast_if_small(wide, max_bytes=100_000) is not wide
    assert broadcast_if_small(wide.limit(0)) is not wide

"""Stand-ins for the library's tables, derived by Spark from the given test tables.

Whole tables and whole texts: every document is a headline, every event a scored headline, every
order a trade. ``bellwire.registry.base`` holds the same definitions as SQL for the checks.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwire.functions.replies import source_column
from bellwire.functions.text import tokens
from bellwire.session import materialise
from bellwire.sources.prices import add_returns

HOLIDAYS = ("2024-01-01", "2024-01-15")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
POSITIVE_WORDS = ("the", "to", "is", "that")
NEGATIVE_WORDS = ("of", "and", "in", "was")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_column() -> Column:
    """One url per document; every tenth repeats its neighbour's, and a few are missing."""
    return F.expr(
        "if(n_chars % 97 = 0, null, concat('https://example.com/', (doc_id div 10) * 9 + least(doc_id % 10, 8)))"
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines from documents: id, source, lang, title, ts, published_at, url, score."""
    ts = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(doc_id * 7919 % 2592000 as decimal(18,6)))"
    docs = table(spark, sf_dir, "documents").withColumn("ts", F.expr(ts))
    published = """
        case when n_chars < 100 then 'date unknown'
             when n_chars < 200 then null
             when n_chars % 6 = 0 then date_format(ts, "yyyy-MM-dd HH:mm:ss'+00:00'")
             when n_chars % 6 = 1 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
             when n_chars % 6 = 2 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'.250Z'")
             when n_chars % 6 = 3 then date_format(ts - interval 5 hours, "yyyy-MM-dd HH:mm:ss'-05:00'")
             when n_chars % 6 = 4 then date_format(ts, "yyyy-MM-dd HH:mm:ss")
             else date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'") end"""
    score = "if(n_chars % 13 = 0, null, (doc_id * 37 % 201 - 100) / 100d)"
    return docs.select(
        F.col("doc_id").alias("id"),
        "source",
        "lang",
        "n_chars",
        F.col("text").alias("title"),
        "ts",
        F.expr(published).alias("published_at"),
        url_column().alias("url"),
        F.expr(score).alias("score"),
    )


def news_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored headline per event, time already typed."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source"), "ts", F.col("value").alias("score")
    )


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading days: weekdays with events, two holidays removed. Stored, as a price table would be."""
    day = F.to_date("ts").alias("trade_date")
    dates = table(spark, sf_dir, "events").select(day).distinct()
    open_days = dates.where((F.weekday("trade_date") < 5) & ~F.col("trade_date").isin(*map(_date, HOLIDAYS)))
    return materialise(open_days, "calendar")


def _date(text: str):
    return F.lit(text).cast("date")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the trading days."""
    events = table(spark, sf_dir, "events").withColumn("trade_date", F.to_date("ts"))
    daily = events.groupBy("trade_date").agg(
        F.min_by("value", "ts").alias("open_price"),
        F.max_by("value", "ts").alias("close_price"),
        F.max("value").alias("high_price"),
        F.min("value").alias("low_price"),
        F.count("*").alias("volume"),
    )
    open_day = (F.weekday("trade_date") < 5) & ~F.col("trade_date").isin(*map(_date, HOLIDAYS))
    return materialise(daily.where(open_day), "bars")


def bars_long(spark: SparkSession, sf_dir: str, by_symbol: bool = False) -> DataFrame:
    """A long daily series from orders; ``by_symbol`` gives one series per order priority."""
    orders = table(spark, sf_dir, "orders").withColumn("trade_date", F.to_date("o_orderdate"))
    keys = ["trade_date"]
    if by_symbol:
        orders = orders.withColumnRenamed("o_orderpriority", "symbol")
        keys = ["symbol", "trade_date"]
    return orders.groupBy(*keys).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open_price"),
        F.max_by("o_totalprice", "o_orderkey").alias("close_price"),
        F.max("o_totalprice").alias("high_price"),
        F.min("o_totalprice").alias("low_price"),
        F.count("*").alias("volume"),
    )


def day_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean sentiment per day and source."""
    orders = table(spark, sf_dir, "orders").withColumn("trade_date", F.to_date("o_orderdate"))
    return orders.groupBy("trade_date", F.col("o_orderpriority").alias("source")).agg(
        (F.avg("o_totalprice") / 500000).alias("sentiment")
    )


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modelling table: long bars, returns, and sentiment columns overall and per source."""
    sentiment = day_source(spark, sf_dir).groupBy("trade_date").agg(
        F.avg("sentiment").alias("avg_sentiment"),
        *[
            F.max(F.when(F.col("source") == p, F.col("sentiment"))).alias(source_column("avg_sentiment", p))
            for p in PRIORITIES
        ],
    )
    return add_returns(bars_long(spark, sf_dir)).join(sentiment, "trade_date", "left")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with made probabilities, ties and both bounds included."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.col("quality").alias("label"),
        (F.expr("cast(doc_id * 37 % 101 as double)") / 100).alias("proba"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.expr("date_add(date'2024-01-02', cast(vec_id % 20 as int))").alias("trade_date"),
        "embedding",
        "label",
    )


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(w, 1) for w in POSITIVE_WORDS] + [(w, -1) for w in NEGATIVE_WORDS]
    return spark.createDataFrame(rows, "word string, polarity int")


def lexicon_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag table over the vocabulary of the documents, with mixed-case repeats."""
    words = table(spark, sf_dir, "documents").select(F.explode(tokens("text")).alias("w")).distinct()
    # ASCII letters only: upper-casing a sharp s would change the word.
    upper = F.translate("w", ascii_lowercase, ascii_uppercase)
    both_cases = words.select(F.explode(F.array(upper, F.col("w"))).alias("Word"))
    return both_cases.select(
        "Word",
        F.when(F.lower("Word").endswith("e"), 2009).otherwise(0).alias("Positive"),
        F.when(F.lower("Word").startswith("a"), 2011).otherwise(0).alias("Negative"),
    )


def article_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored service responses: one JSON page per domain, slice and block of 100 ids.

    A page holding a very short text reports an error, and one holding a very long text is cut off,
    so both failure kinds occur. A page groups at most 100 ids.
    """
    rows = news(spark, sf_dir).select(
        F.concat(F.initcap("source"), F.lit(".example.com")).alias("domain"),
        F.expr("date_add(date'2024-01-01', cast(7 * (id div 500) as int))").alias("slice_start"),
        F.expr("cast(id % 500 div 100 + 1 as int)").alias("page"),
        "id",
        "n_chars",
        F.struct(
            F.concat(F.lit("  "), F.col("title"), F.lit("\n")).alias("title"),
            F.col("published_at").alias("publishedAt"),
            "url",
        ).alias("article"),
    )
    pages = rows.groupBy("domain", "slice_start", "page").agg(
        F.min("n_chars").alias("shortest"),
        F.max("n_chars").alias("longest"),
        F.array_sort(F.collect_list(F.struct("id", "article"))).alias("items"),
    )
    body = F.to_json(
        F.struct(
            F.when(F.col("shortest") < 10, "error").otherwise("ok").alias("status"),
            F.lit(500).alias("totalResults"),
            F.col("items.article").alias("articles"),
        )
    )
    cut = F.when(F.col("longest") > 25000, F.expr("substring(body, 1, length(body) - 1)")).otherwise(F.col("body"))
    return pages.withColumn("body", body).select("domain", "slice_start", "page", cut.alias("body"))

"""Streaming jobs drained over the given files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwire import fixtures as fx
from bellwire.functions.text import clean_title
from bellwire.operators import scoring as sc
from bellwire.registry.base import entry, plain, rounded, sql_r6
from bellwire.registry.news import LM_SQL
from bellwire.session import work_path
from bellwire.streaming import jobs


def _stream(spark, sf, name):
    schema = fx.table(spark, sf, name).schema
    return jobs.read_stream(spark, sf, f"{name}.parquet", schema)


def _event_stream(spark, sf):
    return _stream(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source"), "ts", F.col("value").alias("score")
    )


_SCORES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_pos", T.LongType()),
        T.StructField("n_neg", T.LongType()),
        T.StructField("lm_sentiment_score", T.DoubleType()),
    ]
)


def stream_score(spark, sf):
    lexicon = fx.lexicon(spark)
    docs = _stream(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))

    def score(fresh):
        return sc.score_lexicon(fresh.withColumn("title_clean", clean_title("title")), lexicon)

    return jobs.stream_score(docs, score, _SCORES)


def stream_dedup(spark, sf):
    docs = _stream(spark, sf, "documents").select(F.col("doc_id").alias("id"), fx.url_column().alias("url"), "lang")
    return jobs.stream_insert_or_ignore(docs, "url", "id")


def stream_dedup_batches(spark, sf):
    """The same ingest restarted twice: the ids arrive by their remainder, a micro-batch for each."""
    news = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), fx.url_column().alias("url"), "lang")
    folder, sink, progress = (work_path(spark, f"stream-{label}") for label in ("parts", "sink", "progress"))
    for part in range(3):
        news.where(F.col("id") % 3 == part).write.parquet(f"{folder}/{part}")
        arrived = spark.readStream.schema(news.schema).option("recursiveFileLookup", True).parquet(folder)
        stored = jobs.stream_insert_or_ignore(arrived, "url", "id", sink, progress)
    return stored


def stream_dedup_bounded(spark, sf):
    """Users seen, with all repeats inside the delay, so the result equals the distinct users."""
    events = _stream(spark, sf, "events").select("user_id", "ts")
    return jobs.stream_dedup_bounded(events, "user_id", "ts", "60 days").select("user_id")


def stream_pre_market(spark, sf):
    out = jobs.stream_pre_market(_event_stream(spark, sf), F.col("ts"), fx.days(spark, sf))
    return out.select("id", "source")


def stream_daily_sentiment(spark, sf):
    """Means of the days the watermark has closed; trading days still open are left out."""
    partials = jobs.stream_daily_partials(_event_stream(spark, sf), "ts", "score", fx.days(spark, sf))
    last_closed = partials.select(F.max("utc_day")).scalar()
    daily = jobs.daily_from_partials(partials).where(F.col("trade_date") <= last_closed)
    return plain(rounded(daily, "avg_sentiment"))


ENTRIES = {
    "stream_score": entry(stream_score, LM_SQL),
    "stream_dedup": entry(
        stream_dedup,
        """select id, url, lang from (select *, row_number() over (partition by url order by id) as rn from fx_news)
           where rn = 1 or url is null""",
    ),
    "stream_dedup_batches": entry(
        stream_dedup_batches,
        """select id, url, lang from (select *, row_number() over (partition by url order by id % 3, id) as rn from fx_news)
           where rn = 1 or url is null""",
    ),
    "stream_dedup_bounded": entry(stream_dedup_bounded, "select distinct user_id from events"),
    "stream_pre_market": entry(
        stream_pre_market,
        """select id, source from fx_news_large n where exists (
             select 1 from fx_pre_market w where n.ts >= w.window_start and n.ts < w.window_end)""",
    ),
    "stream_daily_sentiment": entry(
        stream_daily_sentiment,
        f"""with closed as (select date_trunc('day', max(ts) - interval 1 day) as edge from fx_matched)
            select cast(trade_date as varchar) as trade_date, {sql_r6('avg(score)')} as avg_sentiment, count(score) as n
            from fx_matched, closed group by trade_date, edge having trade_date < edge""",
    ),
}

"""Streams equal the batch on replay, also over several micro-batches and after a restart."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwire import fixtures as fx
from bellwire.operators.dedup import insert_or_ignore
from bellwire.operators.sessions import keep_pre_market
from bellwire.streaming import jobs
from bellwire.streaming.keyed import KeyedSink

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("url", T.StringType())])


def put(df, folder, name):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return f"{folder}/{name}"


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def rows(df):
    return sorted(map(tuple, df.select("id", "url").collect()), key=str)


def test_unique_ingest_over_micro_batches_and_restart(spark, tmp_path):
    src, sink, progress = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "cp")
    a = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], SCHEMA)
    b = spark.createDataFrame([(4, "a"), (5, "b"), (6, None)], SCHEMA)
    c = spark.createDataFrame([(7, "b"), (8, "c")], SCHEMA)
    put(a, src, "1")
    put(b, src, "2")
    first = jobs.stream_insert_or_ignore(stream(spark, src), "url", "id", sink, progress)
    assert len(rows(first)) == 4
    put(c, src, "3")
    jobs_result = rows(jobs.stream_insert_or_ignore(stream(spark, src), "url", "id", sink, progress))
    assert (8, "c") in jobs_result and len(jobs_result) == 5
    again = rows(jobs.stream_insert_or_ignore(stream(spark, src), "url", "id", sink, progress))
    assert again == jobs_result


def test_a_retried_micro_batch_overwrites_its_own_rows(spark, tmp_path):
    sink = str(tmp_path / "sink")
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    jobs._write_batch(df, sink, 0)
    fresh = insert_or_ignore(jobs._earlier(spark, sink, SCHEMA, 0), df, ["url"], "id")
    jobs._write_batch(fresh, sink, 0)
    assert rows(jobs._read_sink(spark, sink, SCHEMA)) == [(1, "a"), (2, "b")]


def test_scoring_skips_ids_already_in_the_sink(spark, tmp_path):
    src, sink, progress = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "cp")
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
    put(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), src, "1")
    put(spark.createDataFrame([(2, "b"), (3, "c")], SCHEMA), src, "2")
    scored = jobs.stream_score(stream(spark, src), lambda df: df.select("id", F.lit(0.5).alias("score")), out, "id", sink, progress)
    assert sorted(r.id for r in scored.collect()) == [1, 2, 3]


def test_pre_market_stream_equals_batch(spark, sf_dir):
    days = fx.days(spark, sf_dir)
    events = fx.table(spark, sf_dir, "events")
    live = jobs.read_stream(spark, sf_dir, "events.parquet", events.schema)
    got = jobs.stream_pre_market(live, F.col("ts"), days).select("event_id")
    want = keep_pre_market(events, F.col("ts"), days).select("event_id")
    assert sorted(got.collect()) == sorted(want.collect())


def test_empty_stream_gives_an_empty_sink(spark, tmp_path):
    os.makedirs(tmp_path / "src")
    out = jobs.stream_insert_or_ignore(stream(spark, str(tmp_path / "src")), "url", "id")
    assert out.count() == 0


def test_a_micro_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    sink = KeyedSink(spark, str(tmp_path / "sink"), SCHEMA, "url", "id", buckets=16)
    sink.create()
    many = spark.range(400).select("id", F.expr("if(id % 4 = 0, null, concat('u', id))").alias("url"))
    sink.write(many, 0)
    assert rows(sink.rows()) == rows(many)
    assert sink.read().where("url is null").select("bucket").distinct().count() > 8
    batch = spark.createDataFrame([(900, "u1"), (901, "new"), (902, None)], SCHEMA)
    touched = {r[0] for r in batch.where("url is not null").select(sink.bucket_of()).distinct().collect()}
    seen = sink.seen_keys(batch, 1)
    assert [r.url for r in seen.collect()] == ["u1"]
    read = {f.split("bucket=")[1].split("/")[0] for f in seen.inputFiles() if "bucket=" in f}
    # Bucket -1 is the empty file a sink begins with.
    assert read - {"-1"} <= {str(b) for b in touched}
    stored = sink.read(sorted(touched))
    assert {r[0] for r in stored.select("bucket").distinct().collect()} <= touched
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string>" in plan and "SortMergeJoin" not in plan


def test_a_retried_micro_batch_replaces_its_buckets_alone(spark, tmp_path):
    sink = KeyedSink(spark, str(tmp_path / "sink"), SCHEMA, "url", "id", buckets=4)
    sink.create()
    sink.write(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], SCHEMA), 0)
    batch = spark.createDataFrame([(4, "a"), (5, "c"), (6, None), (7, "c")], SCHEMA)
    for _ in range(2):
        sink.write(insert_or_ignore(sink.seen_keys(batch, 1), batch, ["url"], "id"), 1)
        assert rows(sink.rows()) == [(1, "a"), (2, "b"), (3, None), (5, "c"), (6, None)]


def test_many_micro_batches_equal_one_pass_in_their_order(spark, tmp_path):
    src = str(tmp_path / "src")
    parts = [[(100 * p + i, None if (p + i) % 9 == 0 else f"u{(7 * i + 3 * p) % 40}") for i in range(30)] for p in range(4)]
    for p, part in enumerate(parts):
        put(spark.createDataFrame(part, SCHEMA), src, str(p))
    got = jobs.stream_insert_or_ignore(stream(spark, src), "url", "id", buckets=5)
    known, want = set(), []
    for i, url in (row for part in parts for row in part):
        if url is None or url not in known:
            want.append((i, url))
            known.add(url)
    assert rows(got) == sorted(want, key=str)


def test_bounded_dedup_forgets_keys_behind_the_watermark(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "id long, url string, ts timestamp"
    days = [("2024-01-01", "ab"), ("2024-01-20", "ax"), ("2024-01-21", "y"), ("2024-01-22", "a")]
    for p, (day, urls) in enumerate(days):
        part = spark.createDataFrame([(p, u) for u in urls], "id long, url string")
        put(part.withColumn("ts", F.to_timestamp(F.lit(day))), src, str(p))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    got = sorted((r.url, r.ts.day) for r in jobs.stream_dedup_bounded(live, "url", "ts", "2 days").collect())
    # On day 20 the state of "a" is still there, as the watermark lags one micro-batch; by day 22 it is gone.
    assert got == [("a", 1), ("a", 22), ("b", 1), ("x", 20), ("y", 21)]

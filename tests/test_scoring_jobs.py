"""Scoring jobs that are killed and restarted; remote calls in flight under a cap; plugged-in embeddings."""

import re
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from bellwire.operators import scoring as sc
from bellwire.operators.ledger import ScoringJob, classifier_job, lexicon_job

SCHEMA = "id long, length long"


def news(spark, n, low=0):
    return spark.createDataFrame([(i, "word " * (i % 7)) for i in range(low, n)], "id long, title_clean string")


def lengths(rows):
    return rows.select("id", F.length("title_clean").cast("long").alias("length"))


class Killed(Exception):
    pass


def test_a_killed_job_takes_up_where_it_stopped(spark, tmp_path):
    seen = []

    def dying(rows):
        if len(seen) == 2:
            raise Killed
        seen.append(rows.count())
        return lengths(rows)

    job = ScoringJob(spark, str(tmp_path), SCHEMA)
    with pytest.raises(Killed):
        job.run(news(spark, 500), dying, chunk_rows=100)
    assert len(seen) == 2 and job.scores().count() == sum(seen)
    # What a dying chunk has written is not in the ledger, so nobody reads it.
    lengths(news(spark, 500)).withColumn("run", F.lit(1)).write.parquet(f"{tmp_path}/scores-1-4-halfwritten")
    again, chunks = ScoringJob(spark, str(tmp_path), SCHEMA), []
    out = again.run(news(spark, 520), lambda rows: chunks.append(rows.count()) or lengths(rows), chunk_rows=100, parallelism=2).collect()
    assert sorted(r.id for r in out) == list(range(520))
    assert sum(chunks) == 520 - sum(seen) and {r.run for r in out if r.id >= 500} == {2}
    assert all(r.length == len("word " * (r.id % 7)) for r in out)
    assert again.run(news(spark, 520), dying, chunk_rows=100).count() == 520


def test_jobs_of_empty_tables_null_and_repeated_ids(spark, tmp_path):
    job = ScoringJob(spark, str(tmp_path), SCHEMA)
    assert job.run(news(spark, 0), lengths).count() == 0
    rows = spark.createDataFrame([(1, "a"), (1, "bb"), (None, "c")], "id long, title_clean string")
    assert sorted(r.length for r in job.run(rows, lengths).collect()) == [1, 2]
    assert job.pending(rows).where("id is not null").count() == 0


def test_lexicon_and_classifier_jobs_equal_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(i, ["good good bad", "bad", "none", "", None][i % 5]) for i in range(50)], "id long, title_clean string")
    words = spark.createDataFrame([("good", 1), ("bad", -1)], "word string, polarity int")
    job = lexicon_job(rows, words, str(tmp_path / "l"), chunk_rows=9).drop("run")
    assert sorted(map(str, job.collect())) == sorted(map(str, sc.score_lexicon(rows, words).collect()))
    job = classifier_job(rows, str(tmp_path / "c"), chunk_rows=20).drop("run")
    assert sorted(map(str, job.collect())) == sorted(map(str, sc.score_batches(rows).collect()))


def make_slow():
    def slow_client():
        """Replies with the most calls it has seen in flight and the times of all attempts at a prompt."""
        lock, state, attempts = threading.Lock(), {"now": 0, "most": 0}, {}

        def ask(prompt):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                attempts.setdefault(prompt, []).append(time.monotonic())
            time.sleep(0.05)
            with lock:
                state["now"] -= 1
                if len(attempts[prompt]) == 1 and len(prompt) % 2:
                    raise RuntimeError("busy")
                return f"{state['most']} " + " ".join(f"{t:.4f}" for t in attempts[prompt])

        return ask

    return slow_client


def replies(frame):
    return [[float(x) for x in r.raw.split()] for r in frame.collect()]


def titles(spark, n):
    return spark.createDataFrame([(i, "t" * i) for i in range(n)], "id long, title_clean string").coalesce(1)


def test_calls_run_side_by_side(spark):
    start = time.monotonic()
    got = replies(sc.score_remote(titles(spark, 60), make_slow(), backoff=0.0, in_flight=6))
    assert len(got) == 60 and max(g[0] for g in got) == 6
    assert max(g[-1] for g in got) - min(g[1] for g in got) < 60 * 1.5 * 0.05 / 2 and time.monotonic() > start


def test_retries_count_against_the_cap(spark):
    got = replies(sc.score_remote(titles(spark, 24), make_slow(), backoff=0.0, requests_per_minute=1200, workers=1, in_flight=10))
    times = sorted(t for g in got for t in g[1:])
    assert len(times) == 36 and max(g[0] for g in got) > 1
    # 1,200 a minute are 20 a second: 36 attempts need 35 intervals.
    assert times[-1] - times[0] >= 35 * 0.05 - 0.1
    assert all(b - a > 0.02 for a, b in zip(times, times[1:]))


def test_plugged_in_embeddings(spark):
    def load():
        def predict(texts):
            return np.array([[len(t), t.count("o"), 0.0] for t in texts], dtype="float64").reshape(-1, 3)

        return predict

    rows = spark.createDataFrame([(1, "oo"), (2, ""), (3, None)], "id long, title_clean string")
    got = {r.id: [round(x, 4) for x in r.embedding] for r in sc.embed_batches(rows, load).collect()}
    assert got == {1: [0.7071, 0.7071, 0.0], 2: [0.0, 0.0, 0.0], 3: [0.0, 0.0, 0.0]}
    assert re.match("array<double>", sc.embed_batches(rows, load).schema["embedding"].dataType.simpleString())


def test_a_chunk_is_scored_by_many_tasks(spark, tmp_path, monkeypatch):
    from bellwire.operators import ledger

    monkeypatch.setattr(ledger, "FILE_ROWS", 100)
    parts = []

    def counted(rows):
        parts.append(rows.select(F.input_file_name()).distinct().count())
        return lengths(rows)

    job = ScoringJob(spark, str(tmp_path), SCHEMA)
    assert job.run(news(spark, 2000).coalesce(1), counted, chunk_rows=1000).count() == 2000
    # Before, a chunk was one file.
    assert len(parts) == 2 and min(parts) > 3

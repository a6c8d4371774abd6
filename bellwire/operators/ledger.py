"""Scoring jobs that commit chunk by chunk and take up where they stopped.

A run cuts the rows that have no score yet into numbered chunks by a hash of their id and stores them once. Each
chunk's scores are written to a path of their own and only then entered in the ledger. Whatever is not entered is never
read, so a chunk that was half-written when the job died is scored again, and an entered one never is. The
next run first finishes the chunks of an unfinished one, then cuts what has arrived since.

Layout below the job's folder, which has to be shared storage: ``runs`` (run, chunks, path of the stored rows),
``ledger`` (run, chunk, path of the scores) and the paths they name.
"""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwire.operators.scoring import score_batches, score_lexicon
from bellwire.plans.parallel import run_side_by_side

CHUNK_ROWS = 100_000
#: Rows per file of a chunk, about: a chunk is scored by as many tasks as it has files.
FILE_ROWS = 5_000
#: Chunks that the jobs below score at a time.
SIDE_BY_SIDE = 4
_RUNS = "run int, chunks int, path string"
_ENTRIES = "run int, chunk int, path string"


class ScoringJob:
    """One scoring job in ``folder``; ``schema`` is that of the scores, the id among them. One driver runs it at a time."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, id_col: str = "id"):
        self.spark, self.folder, self.schema, self.id_col = spark, folder.rstrip("/"), schema, id_col
        # Two commits into one folder at a time would clear each other's files.
        self._entering = threading.Lock()
        for name, columns in (("runs", _RUNS), ("ledger", _ENTRIES)):
            spark.createDataFrame([], columns).coalesce(1).write.mode("ignore").parquet(f"{self.folder}/{name}")

    def _rows(self, name: str, columns: str) -> list:
        return self.spark.read.schema(columns).parquet(f"{self.folder}/{name}").collect()

    def _add(self, name: str, columns: str, row: tuple) -> None:
        with self._entering:
            self.spark.createDataFrame([row], columns).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def scores(self) -> DataFrame:
        """All entered scores, with the ``run`` that wrote them."""
        entered = [e.path for e in self._rows("ledger", _ENTRIES)]
        if not entered:
            return self.spark.createDataFrame([], f"{self.schema}, run int")
        return self.spark.read.schema(f"{self.schema}, run int").parquet(*entered)

    def pending(self, news: DataFrame) -> DataFrame:
        """Rows whose id has no entered score."""
        return news.join(self.scores().select(self.id_col), self.id_col, "left_anti").select(*news.columns)

    def _open_chunks(self) -> list[tuple[int, int, str]]:
        done = {(e.run, e.chunk) for e in self._rows("ledger", _ENTRIES)}
        return [(r.run, k, r.path) for r in sorted(self._rows("runs", _RUNS)) for k in range(r.chunks) if (r.run, k) not in done]

    def _cut(self, news: DataFrame, chunk_rows: int) -> None:
        # Stored before they are counted: what makes the rows may be costly.
        pending = f"{self.folder}/pending-{uuid.uuid4().hex}"
        self.pending(news).write.parquet(pending)
        todo = self.spark.read.schema(_ddl(news)).parquet(pending)
        n = todo.count()
        if not n:
            return
        chunks = math.ceil(n / chunk_rows)
        files = math.ceil(min(n, chunk_rows) / FILE_ROWS)
        path = f"{self.folder}/rows-{uuid.uuid4().hex}"
        chunk = F.pmod(F.xxhash64(F.col(self.id_col).cast("string")), F.lit(chunks)).cast("int")
        file = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in news.columns], F.lit("file")), F.lit(files))
        placed = todo.withColumn("_chunk", chunk).repartition(chunks * files, F.col("_chunk"), file)
        placed.write.partitionBy("_chunk").parquet(path)
        number = max((r.run for r in self._rows("runs", _RUNS)), default=0) + 1
        self._add("runs", _RUNS, (number, chunks, path))

    def run(self, news: DataFrame, score: Callable[[DataFrame], DataFrame], chunk_rows: int = CHUNK_ROWS, parallelism: int = 1) -> DataFrame:
        """Score what is pending, chunk by chunk, and return all scores.

        ``score`` takes rows like ``news`` and returns the columns of the schema. Rows with a null id are not scored:
        nothing could tell on a restart whether they had been.
        """
        news = news.where(F.col(self.id_col).isNotNull())
        self._finish(news, score, parallelism)
        self._cut(news, chunk_rows)
        self._finish(news, score, parallelism)
        return self.scores()

    def _finish(self, news: DataFrame, score: Callable[[DataFrame], DataFrame], parallelism: int) -> None:
        names = [f"`{c.strip().split()[0].strip('`')}`" for c in self.schema.split(",")]

        def one(run: int, chunk: int, path: str) -> None:
            stored = self.spark.read.schema(f"{_ddl(news)}, _chunk int").parquet(path)
            rows = stored.where(F.col("_chunk") == chunk).select(*news.columns)
            target = f"{self.folder}/scores-{run}-{chunk}-{uuid.uuid4().hex}"
            score(rows).select(*names).withColumn("run", F.lit(run)).write.parquet(target)
            self._add("ledger", _ENTRIES, (run, chunk, target))

        run_side_by_side(self.spark, [lambda c=c: one(*c) for c in self._open_chunks()], parallelism)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def lexicon_job(news: DataFrame, lexicon: DataFrame, folder: str, id_col: str = "id", text: str = "title_clean", **options) -> DataFrame:
    """Lexicon scores as a resumable job: id, n_pos, n_neg, lm_sentiment_score, run."""
    id_type = news.schema[id_col].dataType.simpleString()
    job = ScoringJob(news.sparkSession, folder, f"{id_col} {id_type}, n_pos bigint, n_neg bigint, lm_sentiment_score double", id_col)
    return job.run(news.select(id_col, text), lambda rows: score_lexicon(rows, lexicon, id_col, text), **{"parallelism": SIDE_BY_SIDE, **options})


def classifier_job(news: DataFrame, folder: str, make_predict_fn: Callable | None = None, id_col: str = "id", text: str = "title_clean", **options) -> DataFrame:
    """Class probabilities as a resumable job: id, one column per class, run."""
    id_type = news.schema[id_col].dataType.simpleString()
    columns = ", ".join(f"finbert_sentiment_{c} double" for c in ("pos", "neutral", "neg"))
    job = ScoringJob(news.sparkSession, folder, f"{id_col} {id_type}, {columns}", id_col)
    return job.run(news.select(id_col, text), lambda rows: score_batches(rows, make_predict_fn, id_col, text), **{"parallelism": SIDE_BY_SIDE, **options})

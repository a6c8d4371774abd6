"""Headline scoring: lexicon, batched classifier, remote model, embeddings; all resumable by id."""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwire.functions.numbers import ratio
from bellwire.functions.replies import PROMPTS, format_prompt, parse_score
from bellwire.functions.text import blank_if_null, tokens
from bellwire.operators.lookup import salted_join
from bellwire.session import broadcast_if_small, materialise
from bellwire.sources.lexicon import positive_first

CLASSES = ("pos", "neutral", "neg")


def lexicon_hits(news: DataFrame, lexicon: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, n_pos, n_neg, blank) for every headline: tokens found in the lexicon, repeats counted.

    Only id and token travel. A headline's tokens leave one task, so the partial sums already
    shrink to one row per headline before the only shuffle; the outer explode and join keep
    headlines without hits in the same pass. The lexicon is stored once and counted: beyond the broadcast
    limit a token with a large share of all tokens is spread over tasks by headline.
    """
    blank = F.coalesce(F.col(text), F.lit("")) == ""
    exploded = news.select(id_col, blank.alias("_blank"), F.explode_outer(tokens(text)).alias("_token"))
    words = materialise(positive_first(lexicon), "lexicon")
    side = broadcast_if_small(words)
    if side is words:
        looked_up = salted_join(exploded, words, "_token", "word", [id_col])
    else:
        looked_up = exploded.join(side, F.col("_token") == F.col("word"), "left")
    return looked_up.groupBy(id_col).agg(
        F.count_if(F.col("polarity") > 0).alias("n_pos"),
        F.count_if(F.col("polarity") < 0).alias("n_neg"),
        F.bool_and("_blank").alias("blank"),
    )


def score_lexicon(news: DataFrame, lexicon: DataFrame, id_col: str = "id", text: str = "title_clean") -> DataFrame:
    """(id, n_pos, n_neg, score): (pos - neg) / (pos + neg), 0 without hits, 4 decimals half to even.

    A NULL or empty headline has a NULL score, so it stays out of day means.
    """
    pos, neg = F.col("n_pos"), F.col("n_neg")
    raw = F.coalesce(ratio(pos - neg, pos + neg), F.lit(0.0))
    return lexicon_hits(news, lexicon, id_col, text).select(
        id_col, pos, neg, F.when(~F.col("blank"), F.bround(raw, 4)).alias("lm_sentiment_score")
    )


def unscored(news: DataFrame, scores: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with no entry in the score table, so a restarted job takes up where it stopped."""
    return news.join(scores.select(id_col), id_col, "left_anti").select(*news.columns)


def keyword_logits(texts: np.ndarray) -> np.ndarray:
    """Offline stand-in classifier: logits from character counts of each text."""
    counts = [(t.count("a"), t.count(" "), t.count("e"), max(len(t), 1)) for t in texts]
    table = np.array(counts, dtype="float64").reshape(-1, 4)
    return table[:, :3] * 8.0 / table[:, 3:]


def logits_model(score: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """Wrap a logits function as a loader returning class probabilities; loaded once per worker."""

    def make_predict_fn():
        def predict(texts: np.ndarray) -> np.ndarray:
            logits = score(texts)
            shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
            return shifted / shifted.sum(axis=1, keepdims=True)

        return predict

    return make_predict_fn


def score_batches(
    news: DataFrame,
    make_predict_fn: Callable | None = None,
    id_col: str = "id",
    text: str = "title_clean",
    batch_size: int = 256,
) -> DataFrame:
    """(id, three class probabilities) from a batch classifier; missing text is scored as ''."""
    predict = predict_batch_udf(
        make_predict_fn or logits_model(keyword_logits),
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
    )
    probs = news.select(id_col, predict(blank_if_null(text)).alias("_p"))
    return probs.select(
        id_col, *[F.col("_p")[i].alias(f"finbert_sentiment_{c}") for i, c in enumerate(CLASSES)]
    )


def net_sentiment(df: DataFrame, prefix: str = "finbert_sentiment") -> DataFrame:
    """``_final`` = pos - neg where both are set; otherwise the value stays as it was."""
    pos, neg, final = (F.col(f"{prefix}_{c}") if f"{prefix}_{c}" in df.columns else None for c in ("pos", "neg", "final"))
    old = F.lit(None).cast("double") if final is None else final
    return df.withColumn(
        f"{prefix}_final", F.when(pos.isNotNull() & neg.isNotNull(), pos - neg).otherwise(old)
    )


def length_client() -> Callable[[str], str]:
    """Offline stand-in for a remote model: the reply depends on the prompt length only."""

    def ask(prompt: str) -> str:
        n = len(prompt)
        value = n * 13 % 301 - 150
        if n % 10 == 0:
            return "not sure"
        return f"{value}e-2" if n % 10 == 1 else f"{value / 100:.2f}"

    return ask


class RateCap:
    """Lets through at most one call per ``interval`` seconds, whichever thread asks; retries count like first calls."""

    def __init__(self, interval: float):
        self.interval, self._next, self._lock = interval, 0.0, threading.Lock()

    def wait(self) -> None:
        if self.interval <= 0:
            return
        with self._lock:
            at = max(time.monotonic(), self._next)
            self._next = at + self.interval
        time.sleep(max(0.0, at - time.monotonic()))


def score_remote(
    news: DataFrame,
    make_client: Callable[[], Callable[[str], str]] = length_client,
    prompt: str = "market_zero_shot",
    id_col: str = "id",
    text: str = "title_clean",
    max_retries: int = 5,
    backoff: float = 2.0,
    requests_per_minute: float | None = None,
    workers: int | None = None,
    in_flight: int | None = None,
) -> DataFrame:
    """(id, raw, score, error) from a remote model called once per row.

    The client is built once per task from ``make_client`` and has to bear calls from several threads. A rate cap is
    shared evenly by ``workers`` partitions (default: the cluster's cores). ``in_flight`` calls of a task run at a
    time (default: 3 % of the task's calls per minute, or 8 without a cap). Failed calls are retried with
    doubling waits; every attempt passes the cap first, so the whole job stays under it.
    """
    if prompt not in PROMPTS:
        raise ValueError(f"unknown prompt {prompt!r}")
    asked = news.select(F.col(id_col).alias("id"), format_prompt(text, prompt).alias("_prompt"))
    interval, threads = 0.0, in_flight or 8
    if requests_per_minute:
        workers = workers or asked.sparkSession.sparkContext.defaultParallelism
        asked = asked.repartition(workers)
        interval = 60.0 * workers / requests_per_minute
        threads = in_flight or max(1, math.ceil(0.03 * requests_per_minute / workers))

    def call(ask: Callable[[str], str], cap: RateCap, message: str) -> tuple[str | None, str | None]:
        for attempt in range(1, max_retries + 1):
            cap.wait()
            try:
                return ask(message).strip(), None
            except Exception as exc:  # noqa: BLE001 - any client failure is retried, then reported
                if attempt == max_retries:
                    return None, f"ERROR: {exc}"
                time.sleep(backoff * 2 ** (attempt - 1))
        return None, "ERROR: no attempt made"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, cap = make_client(), RateCap(interval)
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                replies = list(pool.map(lambda message: call(ask, cap, message), batch["_prompt"]))
                yield pd.DataFrame(
                    {
                        "id": batch["id"],
                        "raw": pd.Series([r for r, _ in replies], index=batch.index, dtype="object"),
                        "error": pd.Series([e for _, e in replies], index=batch.index, dtype="object"),
                    }
                )

    id_type = asked.schema["id"].dataType.simpleString()
    replies = asked.mapInPandas(run, f"id {id_type}, raw string, error string")
    return replies.select("id", "raw", parse_score("raw").alias("score"), "error")


def split_dead_letters(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows without a score). Store ``scored`` first, or the model runs twice."""
    return scored.where(F.col("score").isNotNull()), scored.where(F.col("score").isNull())


def embed_titles(news: DataFrame, dim: int = 16, id_col: str = "id", text: str = "title_clean") -> DataFrame:
    """(id, embedding): unit-length hashed token counts, all in the JVM.

    The token's bucket is the first four hex digits of its MD5, modulo ``dim``. One aggregate per
    headline; a text without tokens gets zeros.
    """
    bucket = F.conv(F.substring(F.md5(F.col("_token")), 1, 4), 16, 10).cast("bigint") % dim
    hashed = news.select(id_col, F.explode_outer(tokens(blank_if_null(text))).alias("_token")).withColumn("_b", bucket)
    counts = hashed.groupBy(id_col).agg(*[F.count_if(F.col("_b") == i).alias(f"_d{i}") for i in range(dim)])
    return counts.select(id_col, unit_length(F.array(*[F.col(f"_d{i}").cast("double") for i in range(dim)])).alias("embedding"))


def embed_batches(news: DataFrame, make_predict_fn: Callable, id_col: str = "id", text: str = "title_clean", batch_size: int = 256) -> DataFrame:
    """(id, embedding) from a plugged-in model, loaded once per worker and fed in batches; missing text is embedded as ''.

    The model may return vectors of any fixed width; they come out at unit length.
    """
    predict = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return news.select(id_col, predict(blank_if_null(text)).alias("_v")).select(id_col, unit_length(F.col("_v")).alias("embedding"))


def unit_length(vec: Column) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(vec, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))

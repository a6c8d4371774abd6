"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. **Marks.** Words and word beginnings that set toxic rows apart are mined from a bounded sample
   of labelled rows (at most ``PER_CLASS`` of each class), by the log-likelihood ratio of their
   document counts. Partial counts are summed in the tasks; only marks with enough support come back.
2. **Voters.** Each lexicon voter holds a share of the marks and fires on a text that has one; pattern
   voters fire on repeated or dense marks, shouting, and exclamation. The given label is one more
   voter, trusted but not certain, and never discounted.
3. **Label model.** Votes are independent given the hidden class but for pairwise correlations.
   Expectation maximisation estimates how often each voter fires in either class; the correlations
   of what is left over discount voters that repeat each other.
4. **Classifier.** Logistic regression on mark counts and patterns, fitted to the posterior labels.

Rows whose crc32 of the id is 0 modulo 5 never teach anything. Labels, language, source and id are no
input of a score. Null or empty texts get the score of a text without any mark. Without labelled
rows of both classes every score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwire.llm.bpe import Known
from bellwire.llm.language import LETTERS
from bellwire.llm.sample import carried, remainder, sample_ids
from bellwire.llm.state import lean, per_worker

PER_CLASS, MARKS, VOTERS = 4000, 160, 12
_STEMS = (4, 5)


def marks_of(word: str) -> list[str]:
    """A word as it is, and its beginnings with a star."""
    return [word, *(word[:n] + "*" for n in _STEMS if len(word) > n)]


def patterns(text: str) -> list[float]:
    """Signs of tone that need no word list, each between 0 and 1."""
    n = max(len(text), 1)
    upper = sum(map(str.isupper, text)) / n
    return [float(upper > 0.3), float(text.count("!") * 50 > n), float(text.count("?") * 50 > n)]


class Scorer:
    """Features of a text: mark counts, how many and how dense, patterns."""

    def __init__(self, marks: list[str], weights: np.ndarray | None = None, bias: float = 0.0):
        self.marks, self.weights, self.bias = marks, weights, bias
        place = {m: i for i, m in enumerate(marks)}
        self._hits = Known(lambda w: tuple(place[m] for m in marks_of(w) if m in place), 1 << 17)

    def features(self, text: str | None) -> np.ndarray:
        text = text or ""
        out = np.zeros(len(self.marks) + 6)
        words = LETTERS.findall(text.lower())
        hits = list(filter(None, map(self._hits.__getitem__, words)))
        for h in hits:
            for i in h:
                out[i] += 1.0
        some = np.minimum(out[: len(self.marks)], 1.0).sum()
        out[: len(self.marks)] = np.log1p(out[: len(self.marks)])
        out[len(self.marks) :] = [np.log1p(some), np.log1p(len(hits)), min(1.0, 20.0 * len(hits) / max(len(words), 1)), *patterns(text)]
        return out

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(self.features(text) @ self.weights + self.bias, -40.0, 40.0))))


def votes(features: np.ndarray, n_marks: int, gold: np.ndarray) -> np.ndarray:
    """Rows x voters, 0 or 1; the last voter is the given label."""
    groups = [features[:, g:n_marks:VOTERS].sum(axis=1) > 0 for g in range(min(VOTERS, n_marks))]
    tail = features[:, n_marks:]
    tone = [tail[:, 0] > np.log(2.5), tail[:, 1] > np.log(3.5), tail[:, 2] > 0.2, *(tail[:, 3:].T > 0.5)]
    return np.stack([*groups, *tone, gold > 0], axis=1).astype(np.float64)


def label_model(fired: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of the positive class per row; firing rates per class, correlations and discounts.

    Starts from the share of voters that fire, with the last voter counted as half of all.
    """
    n, m = fired.shape
    post = np.clip(0.5 * fired[:, -1] + 0.5 * fired[:, :-1].mean(axis=1), 0.01, 0.99)
    discount = np.ones(m)
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        one = np.clip((post @ fired + 0.5) / (post.sum() + 1.0), 1e-3, 1 - 1e-3)
        zero = np.clip(((1 - post) @ fired + 0.5) / ((1 - post).sum() + 1.0), 1e-3, 1 - 1e-3)
        # What the likelier class leaves unexplained: correlated leftovers share their say.
        hard = (post > 0.5).astype(float)
        mean_one = hard @ fired / max(hard.sum(), 1.0)
        mean_zero = (1 - hard) @ fired / max((1 - hard).sum(), 1.0)
        left = fired - hard[:, None] * mean_one - (1 - hard[:, None]) * mean_zero
        cov = left.T @ left / n
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / scale[:, None] / scale[None, :]
        discount = 1.0 / np.maximum(corr.clip(0) ** 2 @ np.ones(m), 1.0)
        discount[-1] = 1.0
        # A voter that fires more often in the other class has lost its meaning.
        useful = one > zero
        on = np.where(useful, np.log(one / zero), 0.0) * discount
        off = np.where(useful, np.log((1 - one) / (1 - zero)), 0.0) * discount
        logit = np.log(prior / (1 - prior)) + fired @ on + (1 - fired) @ off
        post = 1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40)))
    return post, {"fires_in_one": one, "fires_in_zero": zero, "correlation": corr, "discount": discount}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton steps; both classes weigh the same."""
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1)) * len(y)
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + penalty * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        w = w - np.linalg.solve(h, g)
    return w[:-1], float(w[-1])


def mine_marks(rows: DataFrame, sizes: dict[int, int], most: int = MARKS, support: int = 8) -> list[str]:
    """The marks that most favour toxic rows; rows: toxic (0/1), text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = set(LETTERS.findall((text.as_py() or "").lower()))
                seen[toxic].update({m for w in words for m in marks_of(w)})
        marks = sorted(seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array([seen[1][m] for m in marks], pa.int64()), pa.array([0] * len(marks), pa.int64())], names=["mark", "one", "zero"])
        # A mark without toxic rows in this task still has its other rows counted.
        others = sorted(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(others, pa.string()), pa.array([0] * len(others), pa.int64()), pa.array([seen[0][m] for m in others], pa.int64())], names=["mark", "one", "zero"])

    n1, n0 = float(sizes[1]), float(sizes[0])
    counts = rows.mapInArrow(lambda batches: lean(count(batches)), "mark string, one bigint, zero bigint").groupBy("mark").agg(F.sum("one").alias("a"), F.sum("zero").alias("b"))
    a, b = F.col("a"), F.col("b")
    counts = counts.where((a >= support) & ((a / n1) > 4.0 * (b + 0.5) / n0))
    mean = (a + b) / (n1 + n0)
    ratio = a * F.log(a / (n1 * mean)) + F.when(b > 0, b * F.log(b / (n0 * mean))).otherwise(0.0)
    best = counts.select("mark", ratio.alias("ratio")).orderBy(F.desc("ratio"), F.length("mark"), "mark").limit(most)
    return [r.mark for r in best.collect()]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Scorer:
    """Fit on the bounded sample; everything that reaches the driver is bounded by it."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).where(remainder(id_col, 5) != 0)
    known = known.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    ids = sample_ids(known, "toxic", per_class, 2, id_col)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), id_col).select("toxic", "text")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Scorer([], None, float(max(sizes, default=0)))
    scorer = Scorer(mine_marks(rows, sizes))
    marks = scorer.marks

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(marks)
        for batch in batches:
            made = [own.features(t.as_py()).astype(np.float32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes() for m in made], pa.binary())], names=["toxic", "f"])

    # At most two classes of per_class rows with a few hundred numbers each.
    got = rows.mapInArrow(lambda batches: lean(features(batches)), "toxic int, f binary").orderBy("toxic", "f").collect()
    gold = np.array([r.toxic for r in got])
    x = np.stack([np.frombuffer(r.f, np.float32) for r in got]).astype(np.float64)
    post, _ = label_model(votes(x, len(marks), gold))
    weights, bias = logistic(x, post)
    return Scorer(marks, weights, bias)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    ``carry`` adds these columns unchanged, as ``_x0``, ``_x1``, ...
    """
    trained = train(docs, labels, id_col, text_col, **options)
    marks, weights, bias = trained.marks, trained.weights, trained.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = per_worker(("toxicity", tuple(marks), float(bias)), lambda: Scorer(marks, weights, bias), "tables")
        for batch in batches:
            scores = pa.array([own.score(t.as_py()) for t in batch.column(2)], pa.float64())
            more = batch.columns[3:]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores, *more], names=[id_col, "held_out", "score", *(f"_x{i}" for i in range(len(more)))])

    more, more_schema = carried(docs, list(carry))
    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), (remainder(id_col, 5) == 0).alias("held_out"), F.col(text_col).cast("string").alias(text_col), *more)
    scored = rows.mapInArrow(lambda batches: lean(run(batches)), f"{id_col} bigint, held_out boolean, score double{more_schema}")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

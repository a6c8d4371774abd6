"""Daily refits of a small network: the days are spread over Spark tasks, each fit starts afresh.

A refit trains on all earlier days. The rows of a daily series go to every task, behind a check of their
size (``forests.fits_in_tasks``), and a task trains the networks of its days one after another, so hundreds of
refits are one job instead of a chain of jobs each. Training is full-batch Adam on the weighted log loss;
all networks start from the same seeded weights, so a retried task gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bellwire.plans.forests import Rows


@dataclass(frozen=True)
class Network:
    """One hidden layer of rectified units and one logistic output."""

    hidden: int = 64
    steps: int = 100
    rate: float = 0.01
    seed: int = 42

    def train(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Weights and biases of both layers."""
        rng = np.random.default_rng(self.seed)
        at = [rng.standard_normal((x.shape[1], self.hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(self.hidden), rng.standard_normal(self.hidden) * np.sqrt(1 / self.hidden), np.zeros(1)]
        at = [a.astype(x.dtype) for a in at]
        mean, spread = [np.zeros_like(a) for a in at], [np.zeros_like(a) for a in at]
        for step in range(1, self.steps + 1):
            for a, m, s, g in zip(at, mean, spread, self.gradient(at, x, y)):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                a -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return at

    def gradient(self, at: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss."""
        inner = np.maximum(x @ at[0] + at[1], 0)
        wrong = (self._logistic(inner @ at[2] + at[3]) - y) / len(y)
        back = np.outer(wrong, at[2]) * (inner > 0)
        return [x.T @ back, back.sum(axis=0), inner.T @ wrong, wrong.sum(keepdims=True)]

    def predict(self, at: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return self._logistic(np.maximum(x @ at[0] + at[1], 0) @ at[2] + at[3])

    @staticmethod
    def _logistic(z: np.ndarray) -> np.ndarray:
        e = np.exp(-np.abs(z))
        return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def refit_scores(spark, rows: Rows, refits: list[tuple[int, int, int, int]], network: Network) -> DataFrame:
    """``row`` and ``proba`` per scored row; a refit is (first train row, end, first scored row, end).

    Features are scaled by the training rows of the refit.
    """
    x, y = rows.x.astype(np.float32), rows.y.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                past, asked = x[r["start"] : r["end"]], x[r["low"] : r["high"]]
                mean, spread = past.mean(axis=0), past.std(axis=0)
                spread[spread == 0] = 1
                weights = network.train((past - mean) / spread, y[r["start"] : r["end"]])
                proba = network.predict(weights, (asked - mean) / spread).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(r["low"], r["high"])), pa.array(proba)], names=["row", "proba"])

    # Round-robin numbers: late refits, which have more rows, are dealt evenly.
    parts = max(1, min(len(refits), 4 * spark.sparkContext.defaultParallelism))
    tasks = [(*r, i % parts) for i, r in enumerate(refits)]
    frame = spark.createDataFrame(tasks, "start int, end int, low int, high int, part int").repartitionByRange(parts, "part")
    return frame.mapInArrow(run, "row bigint, proba double")

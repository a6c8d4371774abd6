"""Many elastic-net logistic fits at once: every pass over the rows serves all of them.

Each fit is a *problem*: the rows before a date, class weights, and a penalty. Grids, folds and daily refits of one
table differ in nothing else. A pass sums loss, gradient and Hessian of all problems still open, a few numbers
per problem and task; the driver takes a proximal Newton step per problem by coordinate descent on its small
quadratic, halved where the loss did not fall enough. Some ten passes replace a chain of jobs per fit.

The objective is ``C * sum(w * loss) + l1 * |b| + (1 - l1) / 2 * |b|^2``, with a free intercept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a pass (problems x Hessian entries) that are summed together.
MOST_SUMS = 1_000_000
_BATCH = 2048
#: Rounds of coordinate descent between two passes over the rows.
SWEEPS = 100


@dataclass(frozen=True)
class Problem:
    """Rows with ``at`` below ``before``, class weights, inverse penalty strength, share of the l1 penalty."""

    before: int
    weight0: float
    weight1: float
    c: float
    l1: float


def positioned(df: DataFrame, at: Column, label: str, names: Sequence[str] | None = None, features: str = "features") -> DataFrame:
    """``at``, ``y`` and the feature array ``x`` of the rows, from named columns or a vector column."""
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array(features) if names is None else F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    return df.select(at.cast("bigint").alias("at"), F.col(label).cast("double").alias("y"), x.alias("x"))


def _design(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy().reshape(-1, width)
    return batch.column("at").to_numpy(), batch.column("y").to_numpy(), np.hstack([x, np.ones((len(x), 1))])


def _pass(rows: DataFrame, width: int, problems: Sequence[Problem], b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of every problem at its coefficients."""
    size = width + 1
    upper = np.triu_indices(size)
    before = np.array([p.before for p in problems])
    w0, w1 = (np.array([getattr(p, n) for p in problems]) for n in ("weight0", "weight1"))
    each = 1 + size + len(upper[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(problems), each))
        seen = False
        for whole in batches:
            for k in range(0, whole.num_rows, _BATCH):
                at, y, x = _design(whole.slice(k, _BATCH), width)
                seen = True
                m = x @ b.T
                w = np.where(y[:, None] == 1, w1, w0) * (at[:, None] < before)
                e = np.exp(-np.abs(m))
                p = np.where(m >= 0, 1 / (1 + e), e / (1 + e))
                total[:, 0] += (w * (np.log1p(e) + np.maximum(m, 0) - y[:, None] * m)).sum(axis=0)
                total[:, 1 : 1 + size] += (w * (p - y[:, None])).T @ x
                total[:, 1 + size :] += (w * p * (1 - p)).T @ (x[:, upper[0]] * x[:, upper[1]])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(problems)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["problem", "sums"])

    def add(group: pa.Table) -> pa.Table:
        sums = np.sum(group.column("sums").to_pylist(), axis=0)
        return pa.table([group.column("problem").slice(0, 1), pa.array([sums], pa.list_(pa.float64()))], names=["problem", "sums"])

    schema = "problem int, sums array<double>"
    parts = rows.mapInArrow(run, schema)
    if rows.rdd.getNumPartitions() > 1:
        parts = parts.groupBy("problem").applyInArrow(add, schema)
    got = np.zeros((len(problems), each))
    for r in parts.collect():
        got[r.problem] = r.sums
    hessian = np.zeros((len(problems), size, size))
    hessian[:, upper[0], upper[1]] = got[:, 1 + size :]
    hessian[:, upper[1], upper[0]] = got[:, 1 + size :]
    return got[:, 0], got[:, 1 : 1 + size], hessian


def _step(b: np.ndarray, g: np.ndarray, h: np.ndarray, c: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The move to the minimum of every problem's quadratic with its penalty.

    Without an l1 part that is a linear system, otherwise coordinate descent. Descent may stop early: the next pass
    starts from what it reached.
    """
    move = np.zeros_like(b)
    ridge = l1 == 0
    if ridge.any():
        free = np.append(np.ones(b.shape[1] - 1), 0.0)
        left = c[ridge, None, None] * h[ridge] + np.diag(free) + 1e-12 * np.eye(b.shape[1])
        move[ridge] = np.linalg.solve(left, -(c[ridge, None] * g[ridge] + free * b[ridge])[..., None])[..., 0]
    rest = ~ridge
    if rest.any():
        move[rest] = _descent(b[rest], g[rest], h[rest], c[rest], l1[rest])
    return move


def _descent(b: np.ndarray, g: np.ndarray, h: np.ndarray, c: np.ndarray, l1: np.ndarray) -> np.ndarray:
    size = b.shape[1]
    move = np.zeros_like(b)
    turn = np.zeros_like(b)  # h @ move
    for _ in range(SWEEPS):
        largest = 0.0
        for j in range(size):
            hj = h[:, j, j]
            pull = c * (hj * (b[:, j] + move[:, j]) - g[:, j] - turn[:, j])
            if j < size - 1:
                new = np.sign(pull) * np.maximum(np.abs(pull) - l1, 0) / (c * hj + 1 - l1 + 1e-300)
            else:
                new = pull / (c * hj + 1e-300)
            change = new - b[:, j] - move[:, j]
            move[:, j] += change
            turn += change[:, None] * h[:, :, j]
            largest = max(largest, float(np.abs(change).max()))
        if largest < 1e-11 * (1 + float(np.abs(b).max())):
            break
    return move


def fit_many(rows: DataFrame, width: int, problems: Sequence[Problem], tolerance: float = 1e-9, passes: int = 100) -> np.ndarray:
    """Coefficients per problem, the intercept last. ``rows`` come from ``positioned`` and should be stored or cached."""
    per_pass = max(1, MOST_SUMS // ((width + 1) * (width + 4) // 2 + 1))
    if len(problems) > per_pass:
        return np.concatenate([fit_many(rows, width, problems[k : k + per_pass], tolerance, passes) for k in range(0, len(problems), per_pass)])
    c, l1 = np.array([p.c for p in problems]), np.array([p.l1 for p in problems])

    def penalty(b: np.ndarray, k: np.ndarray) -> np.ndarray:
        free = b[:, :-1]
        return l1[k] * np.abs(free).sum(axis=1) + (1 - l1[k]) / 2 * (free**2).sum(axis=1)

    b = np.zeros((len(problems), width + 1))
    move, scale = np.zeros_like(b), np.ones(len(problems))
    value, promised = np.full(len(problems), np.inf), np.zeros(len(problems))
    open_ = np.arange(len(problems))
    for _ in range(passes):
        trial = b[open_] + scale[open_, None] * move[open_]
        loss, g, h = _pass(rows, width, [problems[k] for k in open_], trial)
        now = c[open_] * loss + penalty(trial, open_)
        fell = now <= value[open_] - 1e-4 * scale[open_] * promised[open_] + 1e-12 * np.abs(now)
        scale[open_[~fell]] /= 2
        k = open_[fell]
        b[k], value[k], scale[k] = trial[fell], now[fell], 1.0
        move[k] = _step(b[k], g[fell], h[fell], c[k], l1[k])
        ahead = b[k] + move[k]
        promised[k] = np.maximum(-(c[k] * (g[fell] * move[k]).sum(axis=1) + penalty(ahead, k) - penalty(b[k], k)), 0)
        done = np.abs(move[open_]).max(axis=1) <= tolerance * (1 + np.abs(b[open_]).max(axis=1))
        done |= scale[open_] < 1e-10
        open_ = open_[~done]
        if not len(open_):
            break
    return b


def scores(rows: DataFrame, width: int, coefficients: np.ndarray, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """``problem``, ``at``, ``y``, ``proba`` of every row in the range of ``at`` given for a problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, y, x = _design(batch, width)
            for k, (low, high) in enumerate(ranges):
                mine = np.flatnonzero((at >= low) & (at < high))
                if len(mine):
                    p = 1 / (1 + np.exp(-np.clip(x[mine] @ coefficients[k], -700, 700)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), k, np.int32)), pa.array(at[mine]), pa.array(y[mine]), pa.array(p)], names=["problem", "at", "y", "proba"])

    return rows.mapInArrow(run, "problem int, at bigint, y double, proba double")

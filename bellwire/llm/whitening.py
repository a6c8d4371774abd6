"""Whitening of embeddings: exact sums, pivoted Cholesky of the scatter, one-sided Jacobi on its factor.

An entry ``c`` becomes the whole number ``x = floor(1024 c) + 100000``. Counts and sums of ``x`` are
exact. The scatter of centred vectors is summed by task, one triangle of numbers each, and added up
by position. What reaches the driver is a mean and a matrix of the width of the vectors.

* **Pivoted Cholesky** writes the covariance as ``L L'``, always taking the dimension with the most
  variance left, and stops where nothing but rounding is left: its columns are the rank.
* **One-sided Jacobi** turns pairs of columns of ``L`` until all are at right angles. Since
  ``L L'`` does not change, the squared norms of the columns are then the eigenvalues and the
  normalised columns the components; the covariance is never squared again, so small eigenvalues keep
  their digits. Disjoint pairs are turned together, in the order of a round-robin tournament.

Cases: rows whose vector is null or holds a null or non-finite entry are left out; so are rows of
another width than the most frequent one (the larger of equally frequent ones), empty vectors among
them. Repeated rows and repeated ids count as often as they occur; a null id stays null. Where the
rank is lower than the number of components asked for, only that many components exist: one distinct
vector or an empty table gives no rows. Equal eigenvalues may give any basis of their space. Entries
must stay below 2^40 in size, or the job ends with an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwire.session import materialise

SCALE, SHIFT = 1024.0, 100_000
#: Largest entry, so that whole numbers stay exact.
LARGEST = float(1 << 40)
_SAFE = float(1 << 62)
_WIDE = pa.decimal128(38, 0)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``_id`` and ``_vec`` (doubles) of the rows whose entries are all finite numbers."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("_vec"))
    finite = F.forall("_vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.col("_vec").isNotNull() & (F.size("_vec") > 0) & finite)


def _block(column: pa.Array, width: int) -> np.ndarray:
    """The whole numbers of a batch, less ``SHIFT``."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if np.abs(flat).max(initial=0.0) >= LARGEST:
        raise ValueError("vector entries of 2^40 and more are not supported")
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, width)


def _deviations(block: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly; Python integers where 64 bits might not do."""
    if n * (float(np.abs(block).max(initial=0)) + 1) < _SAFE and max(map(abs, sums.tolist()), default=0) < _SAFE:
        return n * block - sums.astype(np.int64)
    return n * block.astype(object) - sums


def exact_sums(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Row count, and the sums of ``x - SHIFT`` per dimension as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            block = _block(batch.column(0), width)
            n += len(block)
            wide = len(block) * float(np.abs(block).max(initial=0)) >= _SAFE
            total = total + (block.astype(object) if wide else block).sum(axis=0).astype(object)
        if n:
            sums = pa.array([[Decimal(int(t)) for t in total]], pa.list_(_WIDE))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), sums], names=["n", "sums"])

    parts = rows.select("_vec").mapInArrow(run, "n bigint, sums array<decimal(38,0)>")
    by_place = parts.select("n", F.posexplode("sums").alias("d", "s")).groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    got = {r.d: r for r in by_place.collect()}
    if not got:
        return 0, np.zeros(0, object)
    return int(got[0].n), np.array([int(got[d].s) for d in range(width)], object)


def covariance(rows: DataFrame, width: int, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance of ``x`` with divisor ``n``; vectors are centred before they are multiplied."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            centred = (_deviations(_block(batch.column(0), width), n, sums) / n).astype(float)
            total += centred.T @ centred
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total[upper]], pa.list_(pa.float64()))], names=["part"])

    parts = rows.select("_vec").mapInArrow(run, "part array<double>")
    summed = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(upper[0]))
    flat[[r.at for r in summed]] = [r.v for r in summed]
    out = np.zeros((width, width))
    out[upper] = flat
    return (out + np.triu(out, 1).T) / n


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``L`` with ``L L' = v``, one column per step; rows ordered by pivot make it triangular."""
    size = len(v)
    left, waiting = np.diag(v).astype(float).copy(), np.ones(size, bool)
    least = size * np.finfo(float).eps * left.max(initial=0.0)
    factor = np.zeros((size, size))
    for k in range(size):
        pivot = int(np.argmax(np.where(waiting, left, -np.inf)))
        if left[pivot] <= least:
            return factor[:, :k]
        column = (v[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(left[pivot])
        factor[:, k] = np.where(waiting, column, 0.0)
        waiting[pivot] = False
        left = left - factor[:, k] ** 2
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``factor factor'``, falling, and its unit eigenvectors as columns."""
    a = factor.copy()
    m = a.shape[1]
    players = list(range(m)) + ([-1] if m % 2 else [])
    least = np.finfo(float).eps * max(len(a), 1)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = [(p, q) for p, q in zip(players[:half], players[half:][::-1]) if p >= 0 and q >= 0]
            players = [players[0], players[-1], *players[1:-1]]
            i, j = np.array(pairs, int).reshape(-1, 2).T
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            on = np.abs(xy) > least * np.sqrt(xx * yy)
            if not on.any():
                continue
            turned = True
            i, j, x, y, xx, yy, xy = i[on], j[on], x[:, on], y[:, on], xx[on], yy[on], xy[on]
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta**2))
            c = 1 / np.sqrt(1 + t**2)
            a[:, i], a[:, j] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    norms = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    unit = a[:, order] / norms[order]
    # Either sign would do; the largest entry is made positive.
    unit = unit * np.sign(unit[np.abs(unit).argmax(axis=0), np.arange(len(order))]) if len(order) else unit
    return norms[order] ** 2, unit


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per usable row and component: id, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``deviation`` is the exact sum of ``(n x - S)^2``, null where it exceeds a long;
    ``deviation_exact`` holds it with 38 digits. ``whitened`` is the centred vector on the component
    over the root of its eigenvalue, ``explained`` the eigenvalue's share of the trace, and
    ``identity_error`` the largest entry of the covariance of ``whitened`` less the identity.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    empty = spark.createDataFrame(
        [], f"`{id_col}` bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    )
    widths = rows.groupBy(F.size("_vec").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    if not widths:
        return empty
    width = widths[0].w
    rows = rows.where(F.size("_vec") == width)
    n, sums = exact_sums(rows, width)
    v = covariance(rows, width, n, sums)
    values, basis = one_sided_jacobi(pivoted_cholesky(v))
    k = min(components, len(values))
    if not k:
        return empty
    onto = basis[:, :k] / np.sqrt(values[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _deviations(_block(batch.column(1), width), n, sums)
            white = (d / n).astype(float) @ onto
            if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * width >= _SAFE:
                d = d.astype(object)
            away = pa.array([Decimal(int(s)) for s in (d * d).sum(axis=1)], _WIDE)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, k), pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), away, flat], names=["_id", "away", "white"])

    stored = materialise(rows.mapInArrow(run, "_id bigint, away decimal(38,0), white array<double>"), "whitened")
    w = [F.col("white")[i] for i in range(k)]
    means = stored.agg(*[F.avg(c) for c in w]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = stored.agg(*[F.sum((w[i] - F.lit(means[i])) * (w[j] - F.lit(means[j]))) / n for i, j in pairs]).first()
    error = max(abs(g - (i == j)) for g, (i, j) in zip(got, pairs))
    explained = F.array(*[F.lit(float(e)) for e in values[:k] / np.trace(v)])
    out = stored.select(F.col("_id").alias(id_col), "away", F.posexplode("white").alias("at", "whitened"))
    return out.select(
        id_col,
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        F.col("away").try_cast("bigint").alias("deviation"),
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
        F.col("away").alias("deviation_exact"),
    )

"""Approximate nearest neighbours by cosine: several shifted Hilbert orderings, merged windows, exact rerank.

* Unit vectors are turned by a random orthogonal matrix per curve and its first ``DIMS`` coordinates
  are shifted at random and cut into a grid; the Hilbert index of the cell is the sort key. Grid and
  matrices come from a seed, so no row has to be looked at to fit the index and every row is in it.
* Rows are range-partitioned and numbered along each curve. A query meets the rows within
  ``window`` of its own place on every curve; windows are a share of the table, because the recall
  of a curve on vectors without clusters depends on the share of rows looked at.
* Vectors that are equal are one row with their smallest ids, so thousands of copies cost one place on a
  curve and ties still go to the smallest ids.
* Tasks hold one bounded block of a curve and a bounded slice of the queries whose windows touch
  it, and give back the best few of each query. The similarities are cosines in double precision on
  the original vectors, so merging the curves is a plain top-k.

Vectors that are null, of another length than most, zero, or with null or non-finite components take
no part, neither as queries nor as candidates. Null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bellwire.operators.sequence import number_rows
from bellwire.session import materialise

CURVES, DIMS, BITS = 8, 6, 10
#: Share of the rows on either side of a query, per curve, and the least number of rows.
WINDOW, LEAST_WINDOW = 0.09, 512
#: Rows of a block, and queries of a slice.
BLOCK, SLICE = 2048, 8192


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows x dimensions), as int64.

    The transpose form: reflect and exchange from the top bit down, Gray-decode, interleave.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[:, i] & q) > 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def curve_keys(unit: np.ndarray, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """One key per row and curve."""
    rng = np.random.default_rng(seed)
    d = unit.shape[1]
    out = np.empty((len(unit), curves), np.int64)
    for c in range(curves):
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        # Coordinates of most unit vectors lie within a few times 1 / sqrt(d).
        part = np.clip(unit @ turn[:, : min(dims, d)] * np.sqrt(d) / 8, -0.5, 0.5) + 0.5
        shift = rng.random(part.shape[1]) * 0.5
        cells = np.minimum(((part + shift) / 1.5 * (1 << bits)).astype(np.int64), (1 << bits) - 1)
        out[:, c] = hilbert_index(cells, bits)
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows that take part, as ``id`` and ``v`` (doubles)."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("len")).count().orderBy(F.desc("count"), "len").limit(1).select("len")
    return rows.where(F.size("v") == length.scalar())


def nearest(
    vectors: DataFrame,
    is_query: Column | None = None,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    window: float = WINDOW,
    curves: int = CURVES,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` for the ``k`` best rows of each query but itself.

    ``is_query`` is a condition on ``id``. With fewer candidates than ``k`` all are given.
    """
    is_query = F.col("id") % 50 == 0 if is_query is None else is_query
    rows = usable(vectors, id_col, vec_col)
    # Equal vectors: the k + 1 smallest ids stand for all, as no answer can need more of them.
    print_of = F.xxhash64("v")
    few = rows.withColumn("h", print_of).withColumn("nth", F.row_number().over(W.partitionBy("h", "v").orderBy("id"))).where(f"nth <= {k + 1}")
    classes = few.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = rows.where(is_query).select(F.col("id").alias("query_id"), print_of.alias("h"), "v")
    asking = asked.select("h", "v").distinct().withColumn("asks", F.lit(True))
    # A class is known by its smallest id.
    classes = classes.join(asking, ["h", "v"], "left").select(F.col("ids")[0].alias("cls"), "ids", "v", F.coalesce("asks", F.lit(False)).alias("asks"))
    classes = materialise(classes, "vectors")
    n = classes.count()
    reach = max(LEAST_WINDOW, int(window * n))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            unit = v / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300) if len(v) else v
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True) if len(v) else v
            key = curve_keys(unit, curves)
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(v), c), pa.int32()), pa.array(key[:, c], pa.int64()), batch.column(2)], names=["cls", "curve", "key", "asks"])

    keyed = classes.select("cls", "v", "asks").mapInArrow(keys, "cls bigint, curve int, key bigint, asks boolean")
    numbered = number_rows(keyed, ["curve", "key", "cls"], out="place", start=0)
    # Every curve has n rows, so places run from curve * n.
    placed = materialise(numbered.select("cls", "curve", "asks", (F.col("place") - F.col("curve") * n).alias("place")), "curves")
    slices = max(1, -(-placed.where("asks and curve = 0").count() // SLICE))
    width = F.lit(BLOCK)
    held = classes.select("cls", "v")
    blocks = (
        placed.select("cls", "curve", F.floor(F.col("place") / width).alias("block"), "place", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
        .join(held, "cls")
    )
    touched = F.sequence(F.floor(F.greatest(F.lit(0), F.col("place") - reach) / width), F.floor(F.least(F.lit(n - 1), F.col("place") + reach) / width))
    queries = (
        placed.where("asks")
        .select("cls", "curve", "place", F.pmod(F.xxhash64("cls"), F.lit(slices)).cast("int").alias("slice"), F.explode(touched).alias("block"))
        .join(held, "cls")
    )

    def best(met: pa.Table) -> pa.Table:
        asking = met.column("asking")
        block, asks = met.filter(pc.invert(asking)), met.filter(asking)
        found: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if block.num_rows and asks.num_rows:
            order = np.argsort(block.column("cls").to_numpy())
            ids, at = block.column("cls").to_numpy()[order], block.column("place").to_numpy()[order]
            own, own_at = asks.column("cls").to_numpy(), asks.column("place").to_numpy()
            score = cosines(_matrix(asks), _matrix(block)[order])
            score[np.abs(at[None, :] - own_at[:, None]) > reach] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
            value = np.take_along_axis(score, top, axis=1)
            real = np.isfinite(value)
            found = [np.repeat(own, real.sum(axis=1)), ids[top][real], value[real]]
        return pa.table({"query": pa.array(found[0], pa.int64()), "cls": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    by = ["curve", "block", "slice"]
    columns = [*by, "cls", "place", "v"]
    sides = blocks.select(*columns, F.lit(False).alias("asking")).unionByName(queries.select(*columns, F.lit(True).alias("asking")))
    met = sides.groupBy(*by).applyInArrow(best, "query bigint, cls bigint, score double")
    ranked = met.groupBy("query", "cls").agg(F.max("score").alias("score"))
    first = ranked.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "cls"))).where(f"nth <= {k + 1}")
    # Back from classes to ids: every member of a query's class asks, every kept id of a class answers.
    answers = first.join(classes.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    answers = answers.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(f"nth <= {k + 1}")
    answers = answers.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("best"))
    of_class = classes.where("asks").select(F.col("cls").alias("query"), F.xxhash64("v").alias("h"), "v")
    lists = of_class.join(answers, "query").select("h", "v", "best")
    given = asked.join(lists, ["h", "v"]).select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return given.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")
    )


def _matrix(table: pa.Table) -> np.ndarray:
    return np.array(table.column("v").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision; scaling first keeps extreme vectors from overflowing."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return np.clip((a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]), -1.0, 1.0)

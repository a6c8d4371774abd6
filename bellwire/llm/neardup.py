"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, components.

* **Sets.** The distinct word shingles of a text as 64-bit hashes. Texts with equal sets form a class
  and only one row per class goes on, so any number of exact copies costs one aggregation.
* **SuperMinHash.** Element ``e`` draws a random permutation of the slots, one place per level ``j``,
  and offers the value ``j + u`` to the slot at that place. Ranks of one element are thus spread over
  different slots, which lowers the variance. A text stops at the first level below which all its
  slots are filled: later levels can only offer more.
* **Banding.** Bands of as many slots as keep the chance that a pair at the threshold shares no band
  below ``MISS``: 32 bands of 8 at 0.85 (4e-5), 42 bands of 6 at 0.8 (3e-6). The classes of a bucket are linked to its smallest member only, and the
  components of these unverified links are the *candidate clusters*.
* **Verification.** The classes of a cluster are ordered by set size and cut into bounded blocks. A task
  holds two blocks with their full sets, counts all intersections, and returns a spanning forest of
  the true links. First each block meets itself and the next one; then the pairs of blocks that
  may still join different components meet, as far as their sizes allow a link. Members of one known
  component are never compared again, so a large group of near copies costs its blocks once
  and only what is left over meets the rest.

Null, empty and blank texts have no shingles, are linked with nothing and keep themselves. Rows
with a null id form no links and are kept. Rows that share an id are one document as far as links go. Of a very
long text, words and signature are made slice by slice; held whole are its bytes and one hash per shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwire.llm.components import components
from bellwire.llm.shingles import _U, mix, shingle_sets
from bellwire.llm.state import lean
from bellwire.operators.sequence import number_rows
from bellwire.session import materialise

SLOTS, MISS = 256, 1e-4
#: Shingles handled at once while signatures are drawn, and shingle hashes held by one block.
_DRAW, BLOCK_SHINGLES, BLOCK_ROWS = 1 << 14, 1 << 19, 256
#: At most so many ids are broadcast to pick the texts to verify (8 bytes each).
BROADCAST_IDS = 1_000_000


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows x slots, uint64: level above, random part below) of non-empty sets."""
    out = np.empty((len(sets), slots), np.uint64)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    at = 0
    while at < len(order):
        end, total = at, 0
        while end < len(order) and (end == at or total + len(sets[order[end]]) <= _DRAW):
            total += len(sets[order[end]])
            end += 1
        some = [sets[i] for i in order[at:end]]
        best = np.full(len(some) * slots, np.iinfo(np.uint64).max, np.uint64)
        hashes, owner = np.concatenate(some), np.repeat(np.arange(len(some)), [len(s) for s in some])
        # A minimum may be taken slice by slice: a set of any size needs the memory of one slice.
        for k in range(0, len(hashes), _DRAW):
            _draw(hashes[k : k + _DRAW], owner[k : k + _DRAW], best, slots)
        out[order[at:end]] = best.reshape(-1, slots)
        at = end
    return out


def _draw(hashes: np.ndarray, owner: np.ndarray, best: np.ndarray, slots: int) -> None:
    """Lower ``best`` by the offers of these elements, level by level, until no slot can change any more."""
    place = np.tile(np.arange(slots, dtype=np.uint16), (len(hashes), 1))
    element = np.arange(len(hashes))
    for level in range(slots):
        drawn = mix(hashes + _U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        swap = level + (((drawn & _U(0xFFFFFFFF)) * _U(slots - level)) >> _U(32)).astype(np.int64)
        slot = place[element, swap].astype(np.int64)
        place[element, swap] = place[element, level]
        np.minimum.at(best, owner * slots + slot, (_U(level) << _U(32)) | (drawn >> _U(32)))
        most = best.reshape(-1, slots).max(axis=1)
        going = most >= _U((level + 1) << 32)
        left = going[owner]
        if not left.any():
            break
        if left.mean() < 0.5:
            hashes, owner, place = hashes[left], owner[left], place[left]
            element = np.arange(len(hashes))


def band_rows(similarity: float, slots: int = SLOTS, miss: float = MISS) -> int:
    """The most slots per band that lose a pair at ``similarity`` with at most the chance ``miss``."""
    return max((r for r in range(1, 33) if (1 - similarity**r) ** (slots // r) <= miss), default=1)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per row and band."""
    bands = signatures.shape[1] // rows
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for i in range(parts.shape[2]):
        keys = mix(keys * _U(0x100000001B3) + parts[:, :, i])
    return keys.view(np.int64)


def signature_table(docs: DataFrame, width: int, per_band: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, number of shingles, a 128-bit fingerprint of the set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), width))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                for i, row in zip(full, band_keys(super_minhash([sets[i] for i in full]), per_band)):
                    keys[i] = row
            prints = [[int(mix(s ^ _U(salt)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets] for salt in (0, 0x5851F42D4C957F2D)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[0], pa.int64()), pa.array(prints[1], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n", "f1", "f2", "bands"],
            )

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Tables of stages before would wait here unused.
    return texts.mapInArrow(lambda batches: lean(run(batches), "tables"), "id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def forest(sets: list[np.ndarray], known: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links among rows with ``den * intersection >= num * union`` that join different components."""
    hashes = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    pick = shared[number]
    column = (np.cumsum(shared) - 1)[number[pick]]
    owner = owner[pick]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    size = np.array([len(s) for s in sets])
    ok = (num + den) * both >= num * (size[:, None] + size[None, :])
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict[int, int] = {}
    for i, c in enumerate(known.tolist()):
        root[find(i)] = find(first.setdefault(c, i))
    out = []
    for i, j in np.argwhere(np.triu(ok, 1)).tolist():
        x, y = find(i), find(j)
        if x != y:
            root[x] = y
            out.append((i, j))
    return out


def _verify(rows: DataFrame, tasks: DataFrame, num: int, den: int) -> DataFrame:
    """Links found by the tasks (cluster, i, j); rows: cluster, block, rep, comp, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        reps, known = table.column("rep").to_pylist(), table.column("comp").to_numpy()
        sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in table.column("hashes")]
        found = forest(sets, known, num, den)
        yield pa.RecordBatch.from_arrays([pa.array([reps[i] for i, _ in found], pa.int64()), pa.array([reps[j] for _, j in found], pa.int64())], names=["a", "b"])

    sides = tasks.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    # Tasks of one cluster are few per block; the number is salted by (i, j) already.
    joined = sides.join(rows, ["cluster", "block"]).select("cluster", "i", "j", "rep", "comp", "hashes")
    return joined.groupBy("cluster", "i", "j").applyInArrow(lambda t: pa.Table.from_batches(list(lean(run(t.to_batches())))), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``.

    Documents link when ``den * |A and B| >= num * |A or B|`` on their full shingle sets.
    """
    table = materialise(signature_table(docs, width, band_rows(num / den), id_col, text_col), "signatures")
    full = table.where("n > 0 and id is not null")
    classes = materialise(full.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "classes")
    verified = _verified_links(docs, classes, num, den, width, id_col, text_col)
    # A rep that two classes share is one document.
    groups = components(verified)
    of_class = classes.select("n", "f1", "f2", "rep").join(groups, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("n", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = table.select("id", "n", "f1", "f2").join(of_class, ["n", "f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id"))
    )


def _verified_links(docs: DataFrame, classes: DataFrame, num: int, den: int, width: int, id_col: str, text_col: str) -> DataFrame:
    buckets = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    lowest = buckets.groupBy("band", "key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    stars = buckets.join(lowest.select("band", "key", "low"), ["band", "key"]).where("rep > low")
    clusters = materialise(components(stars.select(F.col("rep").alias("a"), F.col("low").alias("b"))), "clusters")
    members = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))

    # Only texts of candidate clusters are read again.
    texts = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).cast("string").alias("text"))
    small = members.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(members) if small else members, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(2), width))
            keep = pa.array([len(s) > 0 for s in sets], pa.bool_())
            columns = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "cluster", "n", "hashes"]).filter(keep)

    sets = wanted.select("rep", "cluster", "text").mapInArrow(lambda batches: lean(run(batches), "tables"), "rep bigint, cluster bigint, n bigint, hashes binary")
    sets = materialise(sets, "sets")

    # First pass: blocks of similar size, each with itself and the next.
    placed = _blocks(sets.select("rep", "cluster", "n").withColumn("comp", F.col("rep")))
    spans = _spans(placed)
    near = spans.select("cluster", F.col("block").alias("i"), F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("j"), "blocks").where("j < blocks")
    first = materialise(_verify(_with_sets(placed, sets), near.select("cluster", "i", "j"), num, den), "links")

    # Second pass, where the first left pairs of blocks unmet: rows ordered by component; blocks of one
    # component need not meet.
    known = components(first)
    left = sets.select("rep", "cluster", "n").join(known, F.col("rep") == F.col("node"), "left")
    left = left.select("rep", "cluster", "n", F.coalesce("component", "rep").alias("comp"))
    unmet = spans.where("block = 0 and blocks > 2").select("cluster")
    open_clusters = left.join(unmet, "cluster").groupBy("cluster").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    placed = _blocks(left.join(open_clusters.select("cluster"), "cluster"), by_component=True)
    spans = _spans(placed)
    other = spans.select("cluster", F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    pairs = spans.join(other, "cluster").where("i0 <= j").where("not (c0 = c1 and d0 = d1 and c0 = d0)")
    pairs = pairs.where(F.col("high") * den >= F.col("low_j") * num).where(F.col("high_j") * den >= F.col("low") * num)
    second = _verify(_with_sets(placed, sets), pairs.select("cluster", F.col("i0").alias("i"), "j"), num, den)
    return materialise(first.unionByName(second), "links")


def _with_sets(placed: DataFrame, sets: DataFrame) -> DataFrame:
    return placed.select("cluster", "block", "rep", "comp").join(sets.select("rep", "hashes"), "rep")


def _blocks(rows: DataFrame, by_component: bool = False) -> DataFrame:
    """``block`` within the cluster: bounded in rows and, by the largest set of the cluster, in shingles.

    Places come from one range-partitioned numbering of all rows, so a large cluster spans tasks.
    """
    order = ["cluster", *(["comp"] if by_component else []), "n", "rep"]
    numbered = number_rows(rows, order, out="_g", start=0)
    per = numbered.groupBy("cluster").agg(F.max("n").alias("most"), F.min("_g").alias("first"))
    room = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(4), F.floor(F.lit(BLOCK_SHINGLES) / F.col("most"))))
    placed = numbered.join(per, "cluster").withColumn("block", F.floor((F.col("_g") - F.col("first")) / room).cast("int"))
    return materialise(placed.select("cluster", "block", "rep", "comp", "n"), "blocks")


def _spans(placed: DataFrame) -> DataFrame:
    """Per block: smallest and largest set, first and last component, blocks of its cluster."""
    spans = placed.groupBy("cluster", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c0"), F.max("comp").alias("c1")
    )
    many = placed.groupBy("cluster").agg((F.max("block") + 1).alias("blocks"))
    return spans.join(many, "cluster").withColumn("i0", F.col("block"))

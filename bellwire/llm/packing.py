"""Packing documents into training sequences: a configuration linear program over the length histogram.

Documents are encoded once and cut into pieces of at most ``capacity`` tokens. Only the histogram of
piece lengths, at most ``capacity`` numbers, reaches the driver. A *configuration* is a multiset of
lengths that fits one sequence, and the program asks for the fewest sequences whose configurations
hold every piece.

* **Multiplicative weights.** Every length has a price, which falls exponentially with the share of
  its pieces already placed. A dynamic program over the capacity (unbounded knapsack) prices all
  configurations at once: its table gives the best one, and the best one that holds a given length.
  Those within ``SLACK`` of the best are used for a step each. Prices divided by the best value
  are a dual solution, so every round also gives a lower bound on the number of sequences.
* **Rounding.** Configurations are used as whole sequences as far as pieces are left for them, and
  what is left over is packed by best fit, longest first, on the histogram. How much is left is bounded by
  the number of configurations, not by the number of pieces.
* **Placing.** Pieces of one length are interchangeable, so the plan says which ranks of a length go to which
  sequence numbers and offset. Each task numbers its pieces per length as it writes them; ranks add the
  counts of earlier tasks. No piece is sorted, and a length that a third of all pieces have is
  spread over the tasks like any other.

Cases: a null text counts as empty, and an empty document holds the end id only. A document is cut only
if it is longer than the capacity. Rows that repeat an id are documents of their own; a null id stays
null. Very long texts are encoded stretch by stretch. An empty table gives no rows. Which of two pieces of equal length
comes first is fixed by the written files, so a retried task changes nothing. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bellwire.llm.bpe import codec
from bellwire.session import broadcast_if_small, materialise

CAPACITY = 4096
#: Configurations within this part of the best value are used.
SLACK = 0.02
#: How fast a price falls with the share of its pieces placed.
ETA = 0.1
#: Share of its scarcest length that one use of a configuration takes.
STEP = 0.5
ROUNDS = 150
#: Configurations taken from one table at most.
PER_ROUND = 4000
#: Rows of a written batch.
_BATCH = 4096


# -- the linear program ---------------------------------------------------------------------------
@dataclass
class Packing:
    """Configurations as (lengths, falling; number of sequences), and the bound of the linear program."""

    capacity: int
    configurations: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    lower_bound: float = 0.0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configurations)

    def places(self) -> np.ndarray:
        """Rows (length, first rank, copies in a sequence, first sequence, offset there), by length and rank.

        Sequences are numbered configuration by configuration; the pieces of one lie longest first.
        """
        rows, ranks, first = [], {}, 0
        for key, n in self.configurations:
            offset = 0
            for length in sorted(set(key), reverse=True):
                copies = key.count(length)
                rows.append((length, ranks.get(length, 0), copies, first, offset))
                ranks[length] = ranks.get(length, 0) + n * copies
                offset += copies * length
            first += n
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def price_table(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By room 0..capacity: the best total price that fits, and the length to take there (0: leave one token free).

    ``prices[l]`` is the price of length ``l``, minus infinity where no piece has it.
    """
    capacity = len(prices) - 1
    back = np.zeros(capacity + 1)  # back[capacity - room] = best value of the room
    take = np.zeros(capacity + 1, np.int64)
    candidates = np.empty(capacity)
    for room in range(1, capacity + 1):
        values = candidates[:room]
        np.add(back[capacity - room + 1 : capacity + 1], prices[1 : room + 1], out=values)
        k = int(values.argmax())
        without = back[capacity - room + 1]
        if values[k] > without:
            back[capacity - room], take[room] = values[k], k + 1
        else:
            back[capacity - room] = without
    return back[::-1], take


def configuration(prices: np.ndarray, best: np.ndarray) -> tuple[list[int], float]:
    """Lengths that fit, each chosen by its price now plus what the table promises for the room behind it."""
    room, out, value = len(prices) - 1, [], 0.0
    while room:
        ahead = prices[1 : room + 1] + best[room - 1 :: -1] if room > 1 else prices[1:2]
        k = int(ahead.argmax())
        if ahead[k] <= 0:
            break
        out.append(k + 1)
        value += float(prices[k + 1])
        room -= k + 1
    return out, value


def fractional_cover(counts: np.ndarray, rounds: int = ROUNDS, slack: float = SLACK, eta: float = ETA) -> tuple[dict[tuple[int, ...], float], float]:
    """Configurations with their use, and the lower bound.

    The table of a round serves for many configurations: prices only fall, so it goes on promising at least
    what can be had, and a configuration worth ``1 - slack`` of its best is as good as the best one now.
    """
    capacity = len(counts) - 1
    held = counts > 0
    need = np.where(held, counts, 1).astype(float)
    size = np.arange(capacity + 1) / capacity
    cover = np.zeros(capacity + 1)
    prices = np.where(held, size, -np.inf)
    use: dict[tuple[int, ...], float] = {}
    bound = 0.0
    for _ in range(rounds):
        best, _ = price_table(prices)
        bound = max(bound, float((need[held] * prices[held]).sum() / best[capacity]))
        if (cover[held] >= need[held]).all():
            break
        for _ in range(PER_ROUND):
            items, value = configuration(prices, best)
            if value < (1 - slack) * best[capacity]:
                break
            times: dict[int, int] = {}
            for item in items:
                if times.get(item, 0) < need[item]:
                    times[item] = times.get(item, 0) + 1
            step = STEP * min(need[k] / t for k, t in times.items())
            key = tuple(sorted((k for k, t in times.items() for _ in range(t)), reverse=True))
            use[key] = use.get(key, 0.0) + step
            for k, t in times.items():
                cover[k] += step * t
                prices[k] = size[k] * np.exp(-eta * cover[k] / need[k])
    # Any prices give a bound; steeper ones tell lengths that must have sequences of their own from mere filler.
    for steep in (0.3, 1.0, 3.0, 10.0, 30.0, 100.0):
        prices = np.where(held, size * np.exp(-steep * np.minimum(cover / need, 700.0 / steep)), -np.inf)
        best, _ = price_table(prices)
        bound = max(bound, float((need[held] * prices[held]).sum() / best[capacity]))
    return use, bound


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for whole groups of equal pieces at a time."""
    groups: dict[int, dict[tuple[int, ...], int]] = {}  # free room -> configurations
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = min((r for r in groups if r >= length), default=None)
            if room is None:
                each = min(capacity // length, n)
                many = n // each
                key = (length,) * each
                at = groups.setdefault(capacity - each * length, {})
                at[key] = at.get(key, 0) + many
                n -= many * each
                continue
            key, many = next(iter(groups[room].items()))
            each = min(room // length, n)
            used = min(many, n // each)
            if used == many:
                del groups[room][key]
                if not groups[room]:
                    del groups[room]
            else:
                groups[room][key] = many - used
            longer = key + (length,) * each
            at = groups.setdefault(room - each * length, {})
            at[longer] = at.get(longer, 0) + used
            n -= used * each
    return [(key, n) for at in groups.values() for key, n in at.items()]


def rounded(use: dict[tuple[int, ...], float], counts: np.ndarray, scale: float, up: float) -> list[tuple[tuple[int, ...], int]]:
    """Whole uses of the scaled configurations as far as pieces are left; a part of ``1 - up`` counts as one. Best fit for the rest."""
    left = {int(k): int(counts[k]) for k in np.flatnonzero(counts)}
    whole: dict[tuple[int, ...], int] = {}
    # Fullest first, so that filler pieces are not spent on sequences with room.
    for key in sorted(use, key=lambda k: (-sum(k), -use[k], k)):
        kinds = {k: key.count(k) for k in set(key)}
        n = min(int(use[key] * scale + up), min(left[k] // t for k, t in kinds.items()))
        if n:
            whole[key] = n
            for k, t in kinds.items():
                left[k] -= n * t
    for key, n in best_fit({k: n for k, n in left.items() if n}, len(counts) - 1):
        whole[key] = whole.get(key, 0) + n
    return sorted(whole.items(), reverse=True)


def pack(counts: np.ndarray) -> Packing:
    """Whole sequences for ``counts[l]`` pieces of each length ``l``; index 0 stays empty.

    The solution is rounded as it is and scaled to the bound, down and to the nearest; the fewest sequences count.
    """
    if not counts.any():
        return Packing(len(counts) - 1)
    use, bound = fractional_cover(counts)
    scales = {1.0, min(1.0, bound / sum(use.values()))}
    tries = [rounded(use, counts, scale, up) for scale in sorted(scales) for up in (0.0, 0.5)]
    return Packing(len(counts) - 1, min(tries, key=lambda c: sum(n for _, n in c)), bound)


# -- pieces ---------------------------------------------------------------------------------------
def cut(chunks: Iterator[list[bytes]], capacity: int, end_id: int) -> Iterator[bytes]:
    """Packed ids of a document with its end id, in pieces of ``capacity``; only the last may be shorter."""
    held, room = b"", 4 * capacity
    for words in chunks:
        held += b"".join(words)
        while len(held) > room:
            yield held[:room]
            held = held[room:]
    held += end_id.to_bytes(4, "little")
    for at in range(0, len(held), room):
        yield held[at : at + room]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` per piece, and its number ``nth`` among the equally long ones of task ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = codec(tokenizer, library_merges=True), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        names = ["_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, data in enumerate(cut(own.chunks(text.as_py() or ""), capacity, end_id)):
                    length = len(data) // 4
                    rows.append((doc_id, k, k * capacity, length, zlib.crc32(data), part, int(seen[length])))
                    seen[length] += 1
                if len(rows) >= _BATCH:
                    yield batch_of()
                    rows = []
        if rows:
            yield batch_of()

    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return texts.mapInArrow(run, "_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` from 0, ``offset``, and the bound ``least_sequences``."""
    stored = materialise(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = materialise(stored.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n
    plan = pack(histogram)
    places = plan.places()
    keys = places[:, 0] << 48 | places[:, 1]
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = stored.join(broadcast_if_small(before), ["part", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = places[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            at = rank - row[:, 1]
            placed = [row[:, 3] + at // row[:, 2], row[:, 4] + at % row[:, 2] * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, placed)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    given = ranked.select("_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    out = given.mapInArrow(run, "_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("_id", id_col).withColumn("least_sequences", F.lit(float(plan.lower_bound)))

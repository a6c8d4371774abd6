"""Token ids on disk: Re-Pair grammars per shard, with random access.

Documents are encoded, ordered by id and cut into shards. Each shard is compressed by Re-Pair:
frequent pairs of ids are replaced by new symbols again and again, and the shard keeps the rules,
the length of every symbol's expansion, and the shortened sequence. Because lengths are stored,
any document, or any range of ids, is decoded without expanding what stands before it.

One round counts all pairs of the shard exactly, and rounds go on until no pair occurs twice. A round
replaces the pairs at least half as frequent as the most frequent one at once, but only such that no
symbol ends one pair and starts another: their occurrences cannot overlap, so the order among them
does not matter. Runs of one symbol are paired from the left. Rules never cross the end id of a
document.

Shard layout, little-endian: magic ``RPG1``; uint32 end id, first new symbol, number of rules,
length of the sequence, number of documents; uint32 rules (left, right); uint32 expansion lengths;
uint32 sequence; int64 document ids; uint8 null flags of those ids; uint32 position of each
document's first symbol in the sequence (documents start at a symbol, as rules do not cross ends).

The shards are binary rows of Parquet files, written by Spark's own committer, so a lost task leaves
nothing half-written. Null texts count as empty and hold the end id only. Null document ids come
first; equal ids are ordered by a hash of the text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bellwire.llm.bpe import codec, runs_by_bytes
from bellwire.session import work_path

MAGIC = b"RPG1"
_HEAD = "<4s5I"
#: Ids per shard, about; one document is never cut.
SHARD_IDS = 1 << 20
#: A round replaces pairs that occur at least this part as often as the most frequent one.
_SHARE = 2
#: Rules of at most this many ids are expanded once for all their places.
_SHORT = 64
#: Documents decoded at once when a shard is read through.
_TOGETHER = 32
#: What stands at a place whose symbol went into a rule.
_GONE = -1


class Grammar:
    """A shortened sequence with its rules; symbols from ``base`` on are rules."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray, sequence: np.ndarray):
        self.base, self.rules, self.lengths, self.sequence = base, rules, lengths, sequence

    def sizes(self, sequence: np.ndarray) -> np.ndarray:
        out = np.ones(len(sequence), np.int64)
        high = sequence >= self.base
        out[high] = self.lengths[sequence[high] - self.base]
        return out

    @cached_property
    def _short(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All plain ids and the expansions of rules of at most ``_SHORT`` ids in one row; where each symbol's starts, and its length."""
        lengths = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        firsts, size = np.arange(len(lengths)), self.base
        flat = np.empty(size + int(self.lengths[self.lengths <= _SHORT].sum()), np.uint32)
        flat[:size] = np.arange(size)
        held = np.argsort(self.lengths, kind="stable")
        ends = np.searchsorted(self.lengths[held], np.arange(2, _SHORT + 2), "left")
        for n, lo, hi in zip(range(2, _SHORT + 1), ends, ends[1:]):
            if lo < hi:
                parts = self.rules[held[lo:hi]].ravel()
                firsts[self.base + held[lo:hi]] = np.arange(size, size + n * (hi - lo), n)
                flat[size : size + n * (hi - lo)] = flat[_spread(firsts[parts], lengths[parts])]
                size += n * int(hi - lo)
        return flat, firsts, lengths

    def expand(self, sequence: np.ndarray) -> np.ndarray:
        """The ids below a stretch of symbols; one pass per level of long rules, and one for all others."""
        seq = np.asarray(sequence).astype(np.int64)
        flat, firsts, lengths = self._short
        while True:
            each = lengths.take(seq)
            high = each > _SHORT
            if not high.any():
                return flat.take(_spread(firsts.take(seq), each))
            at = np.cumsum(1 + high) - 1 - high
            out = np.empty(len(seq) + int(high.sum()), np.int64)
            out[at] = seq
            high = np.flatnonzero(high)
            pairs, at = self.rules.take(seq.take(high) - self.base, axis=0), at.take(high)
            out[at], out[at + 1] = pairs[:, 0], pairs[:, 1]
            seq = out


def compress(ids: np.ndarray, end_id: int, min_count: int = 2) -> Grammar:
    """Re-Pair until no pair occurs ``min_count`` times.

    The places of every pair are listed once. A replacement ends the pairs around it and makes pairs
    with the new symbol, which no other place holds; so a round lists only those, and costs what it replaces.
    """
    size, base = len(ids), int(np.max(ids, initial=end_id)) + 1
    # Narrow numbers where they fit: symbols, and three lists of places, are at most base + 3 * size.
    kind = np.int32 if base + 3 * size < 1 << 31 else np.int64
    sym = np.append(ids, end_id).astype(kind)
    # Neighbours of each place; a replaced pair stays at its left place. One more place is the outside, an end.
    after, before = np.arange(1, size + 2, dtype=kind), np.arange(-1, size, dtype=kind)
    after[size], before[0] = size, size
    rules, lengths, n = [np.zeros((0, 2), np.uint32)], np.ones(base, np.int64), 0
    pair_at = np.full(size + 1, -1, kind)
    # Each place makes one pair at first, and each replacement at most two; the room is used as it fills.
    codes, found, first, places = (np.empty(3 * size + 1, t) for t in (np.uint64, kind, kind, kind))
    known, filled, one = 0, 0, kind(1)
    twins, fresh, left, right = np.zeros(0, np.int64), np.arange(size), sym[:-1], sym[1:]
    while True:
        # Pairs that are new in this round, and of those the ones that may become rules.
        inner, same = (left != end_id) & (right != end_id), left == right
        more_twins = fresh.compress(inner & same)
        new, starts, counts, order = _listed(left, right, fresh, inner & ~same, min_count)
        more, filled_now = known + len(new), filled + len(order)
        pair_at[order] = np.repeat(np.arange(known, more, dtype=kind), counts)
        codes[known:more], found[known:more], first[known:more], places[filled:filled_now] = new, counts, starts + filled, order
        known, filled = more, filled_now
        first[known] = filled
        # Pairs of one symbol with itself are counted anew, as those within a run depend on where it starts.
        twins = np.concatenate([twins, more_twins])
        of = sym.take(twins)
        twins = twins.compress((of == sym.take(after.take(twins))) & (of != _GONE))
        twins.sort()
        twins = twins.compress(np.append(True, twins[1:] != twins[:-1])) if len(twins) else twins
        even = twins.compress(~_odd(twins, after))
        even_sym, twin_sym = sym.take(even), sym.take(twins)
        same, times = np.unique(even_sym, return_counts=True)
        # No replacement makes more pairs of an old symbol with itself, so what is rare now is looked at no more.
        twins = twins.compress(times.take(np.searchsorted(same, twin_sym)) >= min_count) if len(twins) else twins
        most = max(found[:known].max(initial=0), times.max(initial=0))
        if most < min_count:
            break
        least = max(min_count, -(-int(most) // _SHARE))
        often, often_same = np.flatnonzero(found[:known] >= least), same.compress(times >= least)
        best = np.concatenate([codes.take(often), _codes(often_same, often_same)])
        by_count = np.lexsort((best, -np.concatenate([found.take(often), times.compress(times >= least)])))
        pairs, chosen = _compatible(best.take(by_count), base + n)
        chosen = by_count.take(chosen)
        rules.append(pairs.astype(np.uint32))
        lengths = np.concatenate([lengths, lengths[pairs[:, 0]] + lengths[pairs[:, 1]]])
        # Where they still stand, and the symbols to put there.
        mine, put = np.flatnonzero(chosen < len(often)), np.arange(base + n, base + n + len(chosen), dtype=kind)
        numbers = often.take(chosen.take(mine))
        lo = first.take(numbers).astype(np.int64)
        each = first.take(numbers + 1) - lo
        at = places.take(_spread(lo, each)).astype(np.int64)
        held = pair_at.take(at) == np.repeat(numbers.astype(kind), each)
        at, symbols = at.compress(held), np.repeat(put.take(mine), each).compress(held)
        if len(mine) < len(chosen):
            new_of = np.full(base + n, -1, kind)
            new_of[pairs[chosen >= len(often), 0]] = put[chosen >= len(often)]
            hit = new_of.take(even_sym)
            at, symbols = np.concatenate([at, even.compress(hit >= 0)]), np.concatenate([symbols, hit.compress(hit >= 0)])
        gone = after.take(at).astype(np.int64)
        sym[at], sym[gone] = symbols, _GONE
        behind = after.take(gone).astype(np.int64)
        after[at], before[behind] = behind, at
        prior = before.take(at).astype(np.int64)
        ahead = sym.take(prior)
        other = (ahead < base + n) & (prior < size)
        prior = prior.compress(other)
        fresh, left, right = np.concatenate([at, prior]), np.concatenate([symbols, ahead.compress(other)]), np.concatenate([sym.take(behind), symbols.compress(other)])
        # A chosen pair ends at all its places; those around them end there only.
        ended = np.concatenate([pair_at.take(prior), pair_at.take(gone)])
        np.subtract.at(found, ended.compress(ended >= 0).astype(np.int64), one)
        found[numbers] = 0
        pair_at[fresh], pair_at[gone] = -1, -1
        n += len(pairs)
    return Grammar(base, np.concatenate(rules), lengths[base:].astype(np.uint32), sym[:-1][sym[:-1] != _GONE].astype(np.uint32))


def _codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)


def _spread(first: np.ndarray, each: np.ndarray) -> np.ndarray:
    """``first``, ``first + 1``, ... for ``each`` steps, one stretch after another."""
    ends = np.cumsum(each)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + each, each)


def _listed(left: np.ndarray, right: np.ndarray, at: np.ndarray, those: np.ndarray, min_count: int) -> tuple[np.ndarray, ...]:
    """Codes of the pairs with ``min_count`` places, where their places start, how many, and all these places."""
    if not those.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), at[:0]
    bits, low = int(max(left.max(), right.max())).bit_length(), int(at.max()).bit_length()
    if 2 * bits + low <= 64:
        # Pair and place in one number sort faster than by an order.
        keys = left.astype(np.uint64)
        for shift, more in ((bits, right), (low, at)):
            keys <<= np.uint64(shift)
            keys |= more.astype(np.uint64)
        keys = keys[those]
        keys.sort()
        at = (keys & np.uint64((1 << low) - 1)).astype(np.int64)
        keys >>= np.uint64(low)
    else:
        bits, keys, at = 32, _codes(left[those], right[those]), at[those]
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
    starts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    counts = np.diff(starts)
    good = counts >= min_count
    pairs, at, counts = keys.take(starts[:-1].compress(good)), at[np.repeat(good, counts)], counts.compress(good)
    return _codes(pairs >> np.uint64(bits), pairs & np.uint64((1 << bits) - 1)), np.cumsum(counts) - counts, counts, at


def _odd(twins: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Places (ascending) where a pair within a run a, a, a, ... overlaps the one counted before it."""
    if not len(twins):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.concatenate([[True], after[twins[:-1]] != twins[1:]]))
    each = np.diff(np.append(starts, len(twins)))
    return (np.arange(len(twins)) - np.repeat(starts, each)) % 2 == 1


def _compatible(best: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs to replace now, the first ones first, and their places in ``best``."""
    # What a symbol is in this round: 1 starts pairs, 2 ends pairs, 3 is paired with itself.
    role, chosen = bytearray(symbols), bytearray(len(best))
    left, right = (best >> np.uint64(32)).astype(np.int64), (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for k, a, b in zip(range(len(best)), left.tolist(), right.tolist()):
        if role[a] < 2:
            if a == b:
                if not role[a]:
                    role[a] = 3
                    chosen[k] = 1
            elif role[b] in (0, 2):
                role[a] = 1
                role[b] = 2
                chosen[k] = 1
    chosen = np.flatnonzero(np.frombuffer(chosen, np.uint8))
    return np.stack([left.take(chosen), right.take(chosen)], axis=1), chosen


def pack_shard(doc_ids: list[int | None], texts_ids: list[np.ndarray], end_id: int) -> bytes:
    """One shard; every document's ids get ``end_id`` behind them."""
    end = np.array([end_id], np.uint32)
    ids = np.concatenate([x for t in texts_ids for x in (t, end)]) if texts_ids else np.zeros(0, np.uint32)
    grammar = compress(ids, end_id)
    # An id equal to the end id inside a text is no end: lengths say where a document starts.
    lengths = np.array([len(t) + 1 for t in texts_ids], np.int64)
    reached = np.concatenate([[0], np.cumsum(grammar.sizes(grammar.sequence))])
    starts = np.searchsorted(reached, np.cumsum(lengths) - lengths).astype("<u4")
    head = struct.pack(_HEAD, MAGIC, end_id, grammar.base, len(grammar.rules), len(grammar.sequence), len(doc_ids))
    return b"".join([
        head, grammar.rules.astype("<u4").tobytes(), grammar.lengths.astype("<u4").tobytes(), grammar.sequence.astype("<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), starts.tobytes(),
    ])


class Shard:
    """Reads a packed shard; ``ids(k)`` decodes one document only."""

    def __init__(self, data: bytes):
        magic, self.end_id, base, n_rules, n_seq, n_docs = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = struct.calcsize(_HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.grammar = Grammar(base, rules, take("<u4", n_rules), take("<u4", n_seq))
        doc_ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(doc_ids, null)]
        self.starts = np.concatenate([take("<u4", n_docs).astype(np.int64), [n_seq]])
        reached = np.concatenate([[0], np.cumsum(self.grammar.sizes(self.grammar.sequence))])
        self.places = reached[self.starts]

    def ids(self, k: int) -> np.ndarray:
        return self.grammar.expand(self.grammar.sequence[self.starts[k] : self.starts[k + 1]])

    def all_ids(self) -> Iterator[np.ndarray]:
        """The ids of one document after another; stretches of documents are decoded at once."""
        for lo in range(0, len(self.doc_ids), _TOGETHER):
            hi = min(lo + _TOGETHER, len(self.doc_ids))
            whole, places = self.grammar.expand(self.grammar.sequence[self.starts[lo] : self.starts[hi]]), self.places[lo : hi + 1]
            for k in range(hi - lo):
                yield whole[places[k] - places[0] : places[k + 1] - places[0]]

    def window(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the shard, without expanding what stands before."""
        reached = np.cumsum(self.grammar.sizes(self.grammar.sequence))
        first = int(np.searchsorted(reached, start, "right"))
        last = int(np.searchsorted(reached, start + n, "left"))
        before = int(reached[first - 1]) if first else 0
        return self.grammar.expand(self.grammar.sequence[first : last + 1])[start - before : start - before + n]


def write_token_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> str:
    """Encode every whole text and write the shards below ``path`` in ascending id order.

    Each row of the files: ``part``, ``shard`` (its place in the part), ``start`` (ids before it in
    the part), ``n_ids`` and ``data``.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, shard, start = codec(tokenizer, library_merges=True), TaskContext.get().partitionId(), 0, 0
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            row = [[part], [shard], [start], [size], [pack_shard(ids, texts, end_id)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["part", "shard", "start", "n_ids", "data"])

        for batch in batches:
            encoded_texts = (x for some in runs_by_bytes(batch.column(1)) for x in own.encode_batch(some))
            for doc_id, encoded in zip(batch.column(0).to_pylist(), encoded_texts):
                if ids and size + len(encoded) >= shard_ids:
                    yield flush()
                    shard, start, size, ids, texts = shard + 1, start + size, 0, [], []
                ids.append(doc_id)
                texts.append(encoded)
                size += len(encoded) + 1
        if ids:
            yield flush()

    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    tie = F.xxhash64(text_col)
    ordered = texts.repartitionByRange(n, F.col(id_col), tie).sortWithinPartitions(F.col(id_col), tie)
    shards = ordered.mapInArrow(run, "part int, shard int, start bigint, n_ids bigint, data binary")
    shards.write.option("compression", "zstd").parquet(path)
    return path


def read_token_shards(spark, path: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    ``with_ids`` adds the ids themselves. Only one row per part of the files meets in one place.
    """
    shards = spark.read.schema("part int, shard int, start bigint, n_ids bigint, data binary").parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    schema = f"{id_col} bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, data in zip(batch.column(0), batch.column(1)):
                shard, before = Shard(data.as_py()), before.as_py()
                decoded = list(shard.all_ids())
                columns = [shard.doc_ids, (before + shard.places[:-1]).tolist(), [len(x) for x in decoded], [zlib.crc32(x.astype("<u4", copy=False)) for x in decoded]]
                arrays = [pa.array(c, pa.int64()) for c in columns]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in decoded], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    # One row per part, and the writer fixes the number of parts.
    placed = shards.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("start")).alias("before"), "data")
    return placed.mapInArrow(run, schema)


def token_shards(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the shards to a fresh path of the shared work folder and read them back."""
    path = work_path(docs.sparkSession, "token-shards")
    return read_token_shards(docs.sparkSession, write_token_shards(docs, tokenizer, path, **options))

"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore.

* **Terms** are the longest runs of digits, letters and characters beyond ASCII; only A-Z are lower-cased.
* **Index.** Each task cuts its documents into shards of about ``SHARD_BYTES`` of text and numbers the
  documents of a shard by ascending id. A row of the index is one term of one shard: its posting list
  in blocks of ``BLOCK`` documents, each with gaps and frequencies in as few bytes as its largest
  ones need. Beside them stand, uncompressed, the last document of each block and its
  *skyline*: the pairs of document length and frequency that no other pair of the block beats in
  both. Whatever the corpus' mean length, the block's best score is at one of them, so shards can be
  written before the corpus is counted, and the bounds are still exact.
* **Search.** The corpus counts, each query term's document count, and its best score anywhere are small
  aggregates over the index. A shard is then one group: terms whose bounds together cannot lift a document
  into the heap are non-essential. Only lists of essential terms are walked, window by window of
  documents; the others are asked about the candidates, strongest first, and a candidate whose score so
  far, with the maximum of the one block that could hold it and the bounds of the terms still to come,
  does not beat the heap is dropped before that block is decompressed. The heaps of the shards are merged by score.
* **Queries** come in blocks of bounded size, every block against the whole index.

The score is integer arithmetic, see ``score``; equal scores rank by ascending id.

Cases: null texts have no terms, and neither documents nor queries without terms occur in the result. Each row
is a document and a query of its own, also where ids repeat; null ids rank last among equal scores. A
document is never cut: a very long text is read in slices cut between terms and may fill a shard alone. An
empty table on either side gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bellwire.session import work_path

SHARD_BYTES = 16 << 20
#: Documents of a posting block, and documents looked at together in a search.
BLOCK, WINDOW = 128, 4096
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 20
#: A block of queries: items, and bytes of their texts.
QUERY_ITEMS, QUERY_BYTES = 2000, 4 << 20
_ROWS = 50_000

_TERM_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TO_TERMS = bytes(b if b in _TERM_BYTES else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

INDEX_SCHEMA = (
    "shard bigint, term binary, df int, n_docs bigint, n_terms bigint, last array<int>, width array<int>, "
    "sky array<int>, sky_tf array<int>, sky_n array<bigint>, data binary"
)


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, slice by slice."""
    plain, at = (text or b"").translate(_TO_TERMS), 0
    while at < len(plain):
        end = len(plain)
        if at + SLICE < end:
            space = plain.find(b" ", at + SLICE)
            end = space if space >= 0 else end
        yield plain[at:end].split()
        at = end


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whole-number saturation of a frequency at a length norm."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def norm(n_terms: np.ndarray, docs: int, total: int) -> np.ndarray:
    return 25 + (75 * n_terms * docs) // total


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


# -- index ----------------------------------------------------------------------------------------
class ShardBuilder:
    """Collects documents and writes the rows of one shard."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        known, n = self.vocabulary.__getitem__, 0
        for words in terms_of(text):
            self.tokens.append(np.fromiter(map(known, words), np.int32, len(words)))
            n += len(words)
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.size += len(text or b"") + 16

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        lengths = np.array(self.lengths, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words = sorted(self.vocabulary)
        rank = np.empty(len(words), np.int64)
        rank[[self.vocabulary[w] for w in words]] = np.arange(len(words))
        tokens = np.concatenate([np.zeros(0, np.int32), *self.tokens])
        code = np.sort(rank[tokens] << 32 | np.repeat(place, lengths))
        first = np.flatnonzero(np.diff(code, prepend=-1))
        tf = np.diff(np.append(first, len(code)))
        code = code[first]
        by_place = lengths[order]
        ids = np.array([self.ids[i] or 0 for i in order], "<i8")
        null = np.array([self.ids[i] is None for i in order], "u1")
        header = ids.tobytes() + null.tobytes() + by_place.astype("<i8").tobytes()
        yield _row_batch(shard, [[None], [int((lengths > 0).sum())], [len(order)], [int(lengths.sum())], [[]], [[]], [[]], [[]], [[]], [header]])
        if len(code):
            yield from _list_rows(shard, words, code >> 32, code & 0xFFFFFFFF, tf, by_place)


_TYPES = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
_NAMES = ["shard", "term", "df", "n_docs", "n_terms", "last", "width", "sky", "sky_tf", "sky_n", "data"]


def _row_batch(shard: int, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _TYPES)]
    return pa.RecordBatch.from_arrays([pa.array([shard] * len(arrays[0]), pa.int64()), *arrays], names=_NAMES)


def _list_rows(shard: int, words: list[bytes], term: np.ndarray, doc: np.ndarray, tf: np.ndarray, n_terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Posting lists, given as sorted (term, document, frequency), as rows."""
    n = len(term)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(np.append(starts, n))
    inside = np.arange(n) - np.repeat(starts, df)
    block_starts = np.flatnonzero(inside % BLOCK == 0)
    sizes = np.diff(np.append(block_starts, n))
    blocks = -(-df // BLOCK)
    gap = np.diff(doc, prepend=0)
    gap[starts] = doc[starts]

    def bytes_needed(values: np.ndarray) -> np.ndarray:
        most = np.maximum.reduceat(values, block_starts)
        return 1 + (most >= 1 << 8).astype(int) + (most >= 1 << 16) + (most >= 1 << 24)

    wide = np.stack([bytes_needed(gap), bytes_needed(tf)], axis=1)
    raw = np.stack([gap, tf], axis=1).astype("<u4").view(np.uint8).reshape(n, 8)
    used = np.repeat(np.hstack([np.arange(4) < wide[:, :1], np.arange(4) < wide[:, 1:]]), sizes, axis=0)
    data = raw[used]
    # Skyline of a block: going up in document length, only a higher frequency than before counts.
    number = np.repeat(np.arange(len(sizes)), sizes)
    up = np.lexsort((-tf, n_terms[doc], number))
    code = number[up] << 32 | tf[up]
    top = np.maximum.accumulate(code)
    keep = np.append(True, code[1:] > top[:-1])
    sky_per_block = np.bincount(number[up][keep], minlength=len(sizes))
    sky_n, sky_tf = n_terms[doc[up][keep]], tf[up][keep]

    def offsets(per_term: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(per_term)])

    block_at = offsets(blocks)
    data_at = offsets(np.add.reduceat(sizes * wide.sum(axis=1), block_at[:-1]))
    sky_at = offsets(np.add.reduceat(sky_per_block, block_at[:-1]))
    last = doc[block_starts + sizes - 1]
    width = wide[:, 0] * 8 + wide[:, 1]

    for a in range(0, len(df), _ROWS):
        b = min(len(df), a + _ROWS)

        def lists(values: np.ndarray, at: np.ndarray, kind) -> pa.Array:
            part = at[a : b + 1]
            return pa.ListArray.from_arrays(pa.array(part - part[0], pa.int32()), pa.array(values[part[0] : part[-1]], kind))

        part = data_at[a : b + 1]
        blob = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((part - part[0]).astype(np.int32)), pa.py_buffer(data[part[0] : part[-1]])])
        none = pa.nulls(b - a, pa.int64())
        yield _row_batch(shard, [
            words[a:b], pa.array(df[a:b], pa.int32()), none, none, lists(last, block_at, pa.int32()), lists(width, block_at, pa.int32()),
            lists(sky_per_block, block_at, pa.int32()), lists(sky_tf, sky_at, pa.int32()), lists(sky_n, sky_at, pa.int64()), blob,
        ])


def _as_bytes(text_col: str) -> Column:
    return F.col(f"`{text_col}`").cast("string").cast("binary").alias("_text")


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> str:
    """The index of all documents below ``path``; a row without a term describes the documents of its shard.

    Its ``df`` is the number of documents with a term, its ``data`` their ids, null flags and lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, shard = TaskContext.get().partitionId(), 0, ShardBuilder()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, text.as_py())
                if shard.size >= shard_bytes:
                    yield from shard.rows(part << 24 | k)
                    k, shard = k + 1, ShardBuilder()
        if shard.ids:
            yield from shard.rows(part << 24 | k)

    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), _as_bytes(text_col))
    texts.mapInArrow(run, INDEX_SCHEMA).write.parquet(path)
    return path


# -- search ---------------------------------------------------------------------------------------
class PostingList:
    """One list of a shard; blocks are decompressed when first asked for."""

    def __init__(self, last, width, sky, sky_tf, sky_n, data: bytes, df: int, norms, docs: int, total: int):
        self.last, self.data, self.norms = last, data, norms
        self.wide = np.stack([width >> 3, width & 7], axis=1)
        self.starts = np.append(np.arange(0, df, BLOCK), df)
        self.at = np.concatenate([[0], np.cumsum(np.diff(self.starts) * self.wide.sum(axis=1))])
        self.most = np.maximum.reduceat(impact(sky_tf, norm(sky_n, docs, total)), np.cumsum(sky) - sky)
        self.read = np.zeros(len(last), bool)
        # Until a block is read its last document stands for all, which keeps the order.
        self.docs, self.scores = np.repeat(last, np.diff(self.starts)), np.zeros(df, np.int64)

    def load(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.read[blocks]].tolist():
            gaps, freqs = self.wide[b]
            a, z = self.starts[b], self.starts[b + 1]
            raw = np.frombuffer(self.data, np.uint8, (z - a) * (gaps + freqs), self.at[b]).reshape(z - a, gaps + freqs)
            full = np.zeros((z - a, 8), np.uint8)
            full[:, :gaps], full[:, 4 : 4 + freqs] = raw[:, :gaps], raw[:, gaps:]
            values = full.view("<u4").astype(np.int64)
            docs = np.cumsum(values[:, 0]) + (self.last[b - 1] if b else 0)
            self.docs[a:z], self.scores[a:z] = docs, impact(values[:, 1], self.norms[docs])
            self.read[b] = True

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``low`` to before ``high`` and their scores."""
        b, e = np.searchsorted(self.last, low), np.searchsorted(self.last, high - 1) + 1
        self.load(np.arange(b, min(e, len(self.last))))
        a, z = np.searchsorted(self.docs, (low, high))
        return self.docs[a:z], self.scores[a:z]


def top_of_shard(lists: dict[int, PostingList], query: list[tuple[int, int, int]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (documents, scores) above 0; ``query`` holds (term, weight, bound of its score).

    Documents are met in ascending order, so a later one has to beat the heap's least score.
    """
    asked = sorted(((bound, w, lists[t]) for t, w, bound in query if t in lists and w > 0), key=lambda x: x[0])
    sums = np.cumsum([b for b, _, _ in asked])
    heap_docs, heap, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if not asked:
        return heap_docs, heap
    for low in range(0, n_docs, WINDOW):
        high = min(low + WINDOW, n_docs)
        essential = int(np.searchsorted(sums, least, "right"))
        if essential == len(asked):
            break
        held = np.zeros(high - low, np.int64)
        for _, w, found in asked[essential:]:
            docs, scores = found.between(low, high)
            held[docs - low] += w * scores
        rest = int(sums[essential - 1]) if essential else 0
        docs = np.flatnonzero(held)
        docs = docs[held[docs] + rest > least]
        score, docs = held[docs], docs + low
        for bound, w, found in asked[:essential][::-1]:
            if not len(docs):
                break
            rest -= bound
            block = np.searchsorted(found.last, docs)
            inside = block < len(found.last)
            most = np.zeros(len(docs), np.int64)
            most[inside] = w * found.most[block[inside]]
            alive = score + most + rest > least
            docs, score, block, inside = docs[alive], score[alive], block[alive], inside[alive]
            found.load(np.unique(block[inside]))
            at = np.minimum(np.searchsorted(found.docs, docs), len(found.docs) - 1)
            score = score + w * np.where(inside & (found.docs[at] == docs), found.scores[at], 0)
        better = score > least
        heap_docs, heap = np.append(heap_docs, docs[better]), np.append(heap, score[better])
        if len(heap) >= k:
            order = np.lexsort((heap_docs, -heap))[:k]
            heap_docs, heap = heap_docs[order], heap[order]
            least = int(heap[-1])
    return heap_docs, heap


def _query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, Counter]]]:
    block, size = [], 0
    for r in queries.select(F.col(f"`{id_col}`").cast("bigint"), _as_bytes(text_col)).toLocalIterator():
        found = Counter(w for words in terms_of(r[1] and bytes(r[1])) for w in words)
        if found:
            block.append((r[0], found))
            size += len(r[1])
        if len(block) >= QUERY_ITEMS or size >= QUERY_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _bounds(lists: DataFrame, docs: int, total: int) -> DataFrame:
    """Per term number: documents that hold it, and the best impact anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf, n = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            sizes = batch.column(2).value_lengths().to_numpy()
            if len(sizes):
                most = np.maximum.reduceat(impact(tf, norm(n, docs, total)), np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(most)], names=["no", "df", "most"])

    each = lists.select("no", F.col("df").cast("bigint").alias("df"), "sky_tf", "sky_n").mapInArrow(run, "no int, df bigint, most bigint")
    return each.groupBy("no").agg(F.sum("df").alias("df"), F.max("most").alias("most"))


def _search_block(index: DataFrame, block: list[tuple[int | None, Counter]], docs: int, total: int, k: int, first: int) -> DataFrame:
    spark = index.sparkSession
    numbers = {w: i for i, w in enumerate(sorted({w for _, found in block for w in found}))}
    # The terms of a block of queries are bounded by its bytes.
    asked = spark.createDataFrame([(w, i) for w, i in numbers.items()], "term binary, no int")
    lists = index.where("term is not null").join(F.broadcast(asked), "term")
    known = {r.no: (weight(r.df, docs), r.most) for r in _bounds(lists, docs, total).collect()}
    queries = []
    for item, (item_id, found) in enumerate(block, first):
        terms = [(numbers[w], known[numbers[w]][0] * n) for w, n in found.items() if numbers[w] in known]
        queries.append((item, item_id, [(no, w, w * known[no][1]) for no, w in terms]))

    def run(group: pa.Table) -> pa.Table:
        rows = group.combine_chunks()
        no = rows.column("no").to_pylist()
        whole = {c: rows.column(c).combine_chunks() for c in ("last", "width", "sky", "sky_tf", "sky_n", "data", "df", "n_docs")}
        head = no.index(None)
        n_docs = whole["n_docs"][head].as_py()
        header = whole["data"][head].as_py()
        ids, null = np.frombuffer(header, "<i8", n_docs), np.frombuffer(header, "u1", n_docs, 8 * n_docs)
        norms = norm(np.frombuffer(header, "<i8", n_docs, 9 * n_docs), docs, total)

        def numbers_of(column: str, i: int) -> np.ndarray:
            return whole[column][i].values.to_numpy().astype(np.int64)

        lists = {
            t: PostingList(*[numbers_of(c, i) for c in ("last", "width", "sky", "sky_tf", "sky_n")], whole["data"][i].as_py(), whole["df"][i].as_py(), norms, docs, total)
            for i, t in enumerate(no)
            if t is not None
        }
        out: list[tuple] = []
        for item, item_id, terms in queries:
            found, scores = top_of_shard(lists, terms, n_docs, k)
            out += [(item, item_id, None if null[d] else int(ids[d]), s) for d, s in zip(found.tolist(), scores.tolist())]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["item", "item_id", "doc_id", "score"])

    heads = index.where("term is null").withColumn("no", F.lit(None).cast("int"))
    columns = ["shard", "no", "df", "n_docs", "last", "width", "sky", "sky_tf", "sky_n", "data"]
    shards = lists.select(*columns).unionByName(heads.select(*columns))
    return shards.groupBy("shard").applyInArrow(run, "item bigint, item_id bigint, doc_id bigint, score bigint")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per query row its ``k`` best documents with a score above 0: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``."""
    index = spark.read.schema(INDEX_SCHEMA).parquet(path)
    docs, total = index.where("term is null").agg(F.sum("df"), F.sum("n_terms")).first()
    schema = "item bigint, item_id bigint, doc_id bigint, score bigint"
    if not total:
        return spark.createDataFrame([], f"{id_col} bigint, rank int, doc_id bigint, score bigint")
    sink, first = work_path(spark, "search"), 0
    spark.createDataFrame([], schema).write.parquet(sink)
    for block in _query_blocks(queries, id_col, text_col):
        _search_block(index, block, docs, total, k, first).write.mode("append").parquet(sink)
        first += len(block)
    best = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = spark.read.schema(schema).parquet(sink).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").alias(id_col), "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Index ``docs`` in the shared work folder and search it for every row of ``queries``."""
    spark = docs.sparkSession
    return search(spark, write_index(docs, work_path(spark, "search-index")), queries, k)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
SQL = f"""
with doc_terms as (select doc_id, unnest(regexp_extract_all({_LOWER}, {_RUNS})) as term from documents),
tf as (select doc_id, term, count(*)::bigint as tf from doc_terms group by all),
lengths as (select doc_id, sum(tf)::bigint as n from tf group by all),
corpus as (select count(*)::bigint as docs, sum(n)::bigint as total from lengths),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::double))::bigint as w from tf, corpus group by term),
query as (select item_id, term, count(*)::bigint as times
          from (select item_id, unnest(regexp_extract_all({_LOWER}, {_RUNS})) as term from benchmark) group by all),
scored as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::bigint as score
           from query join weights using (term) join tf using (term) join lengths using (doc_id), corpus group by all)
select item_id, rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank from scored where score > 0)
where rank <= 10
"""

"""Ranked search against scoring every document for every query."""

import math
import random
import re
from collections import Counter

import numpy as np

from bellwire.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, queries, k=10):
    held = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in queries:
        scores = []
        for d, c, size in held:
            m = 25 + (75 * size * n) // total
            score = 0
            for w in TERM.findall(lower(text)):
                if w in c:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def got(frame):
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def words(rng, n):
    return " ".join(f"w{min(int(rng.paretovariate(0.9)), 400)}" for _ in range(n))


def test_many_shards_equal_scoring_all(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i * 7 % 3001, words(rng, rng.randint(1, 60))) for i in range(3000)]
    queries = [(i, words(rng, rng.randint(1, 12)) + " zzz") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    path = lexical.write_index(frame, str(tmp_path / "index"), shard_bytes=30_000)
    assert spark.read.parquet(path).where("term is null").count() > 6
    found = lexical.search(spark, path, spark.createDataFrame(queries, "item_id long, text string"))
    assert order(got(found)) == order(brute(docs, queries))


def test_odd_rows(spark):
    long = "Ärger É-mail x_y Z9 " * 90_000 + "unique"
    docs = [(1, None), (2, ""), (3, "... !!"), (4, long), (5, "A b\x00c É é"), (5, "A b\x00c É é"), (None, "a b c"), (None, "a b c"), (9, "a " * 50)]
    docs += [(20 + i, "same words here") for i in range(30)]
    queries = [(1, None), (1, "Same here"), (1, "Same here"), (2, "a A é b unique Z9"), (3, "nothing-known"), (None, "c É")]
    # No repeated query id may hide a row: compare as lists.
    table = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, score int, term string").repartition(4)
    asked = spark.createDataFrame([(i, t, 2) for i, t in queries], "item_id long, text string, rank int")
    assert order(got(lexical.rank_documents(table, asked))) == order(brute(docs, queries))
    assert lexical.rank_documents(table.where("false"), asked).count() == 0
    assert lexical.rank_documents(table, asked.where("false")).count() == 0
    assert lexical.rank_documents(table.where("doc_id < 4"), asked).count() == 0


def shard_lists(docs):
    builder = lexical.ShardBuilder()
    for d, t in docs:
        builder.add(d, t.encode())
    batches = list(builder.rows(0))
    n, total = batches[0].column("df")[0].as_py(), batches[0].column("n_terms")[0].as_py()
    norms = lexical.norm(np.frombuffer(batches[0].column("data")[0].as_py(), "<i8", len(docs), 9 * len(docs)), n, total)
    lists = {}
    for r in batches[1].to_pylist():
        arrays = [np.array(r[c], np.int64) for c in ("last", "width", "sky", "sky_tf", "sky_n")]
        lists[r["term"].decode()] = (lexical.PostingList(*arrays, r["data"], r["df"], norms, n, total), lexical.weight(r["df"], n))
    return lists


def test_blocks_are_left_compressed():
    """A rare and a common term: once the heap is full, only blocks with a candidate are read."""
    docs = [(i, ("common " if i % 2 else "other ") * (1 + i % 3) + ("rare " * 5 if i % 997 == 1 else "")) for i in range(30_000)]
    lists = shard_lists(docs)
    query = [(t, w, w * int(p.most.max())) for t, (p, w) in lists.items() if t in ("common", "rare")]
    found, scores = lexical.top_of_shard({t: p for t, (p, _) in lists.items()}, query, len(docs), 10)
    assert [(r[2], r[3]) for r in brute(docs, [(0, "common rare")])] == list(zip(found.tolist(), scores.tolist()))
    common = lists["common"][0]
    assert len(common.read) > 100 and common.read[40:].mean() < 0.4
    # A block's maximum is the best score in it, whatever the lengths.
    common.load(np.arange(len(common.read)))
    assert (common.most == [common.scores[a:z].max() for a, z in zip(common.starts, common.starts[1:])]).all()


def test_queries_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_ITEMS", 3)
    docs = [(i, f"a{i % 5} b{i % 7}") for i in range(60)]
    queries = [(i, f"a{i % 5} b{i % 3}") for i in range(8)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    assert order(got(lexical.rank_documents(*frames))) == order(brute(docs, queries))

"""Packing: plans against small exact optima, placing against a plain check; whitening against a plain eigensolver."""

import itertools
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from bellwire.llm import packing  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """The optimum by trying sequences for the pieces one after another."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i, r in enumerate(rooms):
            if r >= lengths[k]:
                place(k + 1, (*rooms[:i], r - lengths[k], *rooms[i + 1 :]))
        place(k + 1, (*rooms, capacity - lengths[k]))

    place(0, ())
    return best


def counts_of(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


def test_price_table_equals_trying_all():
    rng = np.random.default_rng(0)
    prices = np.full(13, -np.inf)
    prices[[3, 4, 7, 9]] = rng.random(4)
    best, _ = packing.price_table(prices)
    for room in range(13):
        every = [sum(prices[list(c)]) for k in range(5) for c in itertools.combinations_with_replacement([3, 4, 7, 9], k) if sum(c) <= room]
        assert best[room] == pytest.approx(max(every))


def test_plans_hold_every_piece_and_are_near_the_optimum():
    rng = np.random.default_rng(1)
    for _ in range(15):
        lengths = sorted(rng.integers(1, 31, rng.integers(1, 10)).tolist(), reverse=True)
        plan = packing.pack(counts_of(lengths, 30))
        placed = sorted((x for key, n in plan.configurations for x in key * n), reverse=True)
        assert placed == lengths and all(sum(key) <= 30 for key, _ in plan.configurations)
        least = fewest(lengths, 30)
        assert plan.lower_bound <= least + 1e-9 and least <= plan.sequences <= least + 1


def test_plans_of_large_counts():
    rng = np.random.default_rng(2)
    counts = counts_of(rng.integers(1, 4097, 50_000), 4096)
    counts[1500] += 40_000_000
    plan = packing.pack(counts)
    used = np.zeros(4097, np.int64)
    for key, n in plan.configurations:
        assert sum(key) <= 4096
        np.add.at(used, list(key), n)
    assert (used == counts).all() and plan.sequences <= plan.lower_bound * 1.002 + 2
    # Half-capacity-and-one pieces cannot share a sequence, whatever their volume.
    plan = packing.pack(counts_of([2049] * 1000, 4096))
    assert plan.sequences == 1000 and plan.lower_bound > 999


def plain_pieces(texts):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    out = []
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            out.append((doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    return out


def check(rows, texts):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(plain_pieces(texts), key=key)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by_sequence) <= sum(r.length for r in rows) / 4096 * 1.05 + 1


def test_documents_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, PATH).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    volume = sum(r.length for r in rows) / 4096
    assert rows[0].least_sequences <= len({r.sequence_id for r in rows}) <= volume + 2


def test_odd_documents(spark):
    texts = [(1, None), (2, ""), (3, "the and " * 30_000), (3, "the and " * 30_000), (None, "of it"), (5, "word " * 4095), (6, "word " * 4096)] + [(10 + i, "a b c") for i in range(300)]
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in texts], "doc_id long, text string, piece string, sequence_id int").repartition(5)
    check(packing.pack_documents(docs, PATH).collect(), texts)
    assert packing.pack_documents(docs.where("false"), PATH).count() == 0

"""Corpus counts that grow with the input, and index searches over several blocks, against plain versions."""

import math
import random

import numpy as np
import pytest
import xxhash

from bellwire.llm import components, hilbert, quality


def plain_ratio(rows, trusted, buckets):
    half = buckets // 2

    def signed(word):
        h = xxhash.xxh64_intdigest(word.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    def places(text):
        h = [signed(w) for w in (text or "").split()]
        return [x % half for x in h] + [(x ^ (y >> 1)) % half + half for x, y in zip(h, [*h[1:], 0])]

    raw, good = np.zeros(buckets), np.zeros(buckets)
    for i, text in rows:
        np.add.at(raw, places(text), 1)
        if i in trusted:
            np.add.at(good, places(text), 1)
    weight = [
        round(math.log((y + 1) / (good.sum() + buckets)) - math.log((x + 1) / (raw.sum() + buckets)), 6) if good.any() else 0.0 for x, y in zip(raw, good)
    ]
    return [sum(weight[b] for b in places(text)) / max(1, len(places(text))) for _, text in rows]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_quality_ratio_counts_every_trusted_row(spark, monkeypatch, limit):
    monkeypatch.setattr(quality, "BROADCAST_IDS", limit)
    rng = random.Random(3)
    kinds = [[f"{kind}{k}" for k in range(200)] for kind in ("fine", "poor", "both")]
    rows = [(i, " ".join(rng.choice(kinds[rng.choice([i % 2, 2])]) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(None, "fine1 poor2"), (4, "fine7 " * 30), (900, None), (901, "")]
    trusted = {i for i in range(0, 400, 2) if i % 3}
    labels = [(i, 1) for i in trusted] + [(i, 1) for i in (2, 8)] + [(1, 0), (3, None), (None, 1), (5000, 1)]
    docs = spark.createDataFrame([(i, t, k, True) for k, (i, t) in enumerate(rows)], "doc_id long, text string, id int, good boolean")
    got = quality.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), buckets=1 << 10).collect()
    want = plain_ratio(rows, trusted, 1 << 10)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    mine = sorted(((r.doc_id, r.n_words, r.score) for r in got), key=key)
    plain = sorted(((i, len((t or "").split()), s) for (i, t), s in zip(rows, want)), key=key)
    assert [x[:2] for x in mine] == [x[:2] for x in plain]
    assert np.allclose([x[2] for x in mine], [x[2] for x in plain], atol=1e-9)
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in got)


def test_nearest_over_several_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "SLICE", 40)
    rng = np.random.default_rng(11)
    v = rng.standard_normal((5200, 32))
    v[4000:4010] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(6)
    got = {}
    for r in hilbert.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 5200, 50))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    met = 0
    for q, found in got.items():
        score = unit @ unit[q]
        best = [i for i in np.lexsort((np.arange(5200), -np.round(score, 12))) if i != q][:5]
        met += len(set(best) & {i for i, _ in found})
        assert len(found) == 5 and np.allclose([s for _, s in found], score[[i for i, _ in found]], atol=1e-12)
    assert met >= 0.9 * 5 * len(got)
    assert [i for i, _ in got[0]] == list(range(4000, 4005))


def test_hub_with_more_links_than_a_partition(spark):
    links = [(0, k) for k in range(1, 3000)] + [(k, 5000 + k) for k in range(1, 3000, 7)] + [(9000, k) for k in range(9001, 9500)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect())
    assert got == {i: 0 for pair in links[: 2999 + 429] for i in pair} | {i: 9000 for i in range(9000, 9500)}

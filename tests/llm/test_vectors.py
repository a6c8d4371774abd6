import numpy as np

from bellwire.llm import hilbert


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        place = hilbert.hilbert_index(grid, bits)
        assert sorted(place.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def exact(rows, k):
    out = {}
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, v in good:
        if i % 50 == 0:
            near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w in good if j != i)
            out[i] = [j for _, j in near[:k]]
    return out


def test_nearest_on_small_and_odd_tables(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    rows += [(5000, None), (5050, [0.0] * 8), (5100, [float("nan")] + [1.0] * 7), (5150, [None] + [1.0] * 7), (5200, [1.0] * 3), (5250, [float("inf")] * 8)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, rank string")
    got = {}
    for r in hilbert.nearest(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = exact(rows, 5)
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == want
    few = hilbert.nearest(table.where("vec_id in (0, 1)")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]
    assert hilbert.nearest(table.where("false")).count() == 0


def test_recall_on_vectors_without_clusters():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    place = np.argsort(np.argsort(hilbert.curve_keys(x), axis=0), axis=0)
    asked = np.arange(0, 6000, 50)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -2
    top = np.argsort(-score, axis=1)[:, :5]
    near = (np.abs(place[top] - place[asked][:, None]) <= hilbert.WINDOW * 6000).any(axis=2)
    assert near.mean() >= 0.9

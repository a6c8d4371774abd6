"""Nested search of random forests: grown once per feature rule and fold, cut to every smaller setting.

A forest of fewer trees is the first trees of a larger one, a lower one is the same trees cut at a level,
and a larger minimum split turns nodes with fewer rows into leaves. Every node keeps its class
weights, so a cut tree needs no fit of its own. A grid of 48 settings over 5 folds thus takes 10 grown forests.

The work is spread over Spark tasks by tree: a task grows a few trees level by level, all their open nodes at
once, and scores the fold's test rows at every cut. A random choice depends on tree, node and
feature only, so neither batches nor retries change a tree. The rows of a daily series go to every task, behind
a check of their size; above it ``fits_in_tasks`` says no and the plain search over Spark's own
forests is used. The chosen forest becomes a Spark model, which predicts, explains and saves like any other.

A bootstrap sample has as many draws as rows. A node is split at the best weighted Gini gain over all
thresholds of ``max_features`` features drawn for it, unless it is pure, at the depth limit, has fewer
different rows than the minimum, or has no two values to part. Ties go to the feature drawn first, then to
the lowest threshold.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwire.session import work_path

#: Numbers of a frame that may go to every task (8 bytes each).
MOST_CELLS = 4_000_000
#: Deepest level, as in Spark's forests; stands for "no limit".
MAX_DEPTH = 30
TREES_PER_TASK = 25


@dataclass(frozen=True)
class Rows:
    """Feature rows in date order, with class weights."""

    x: np.ndarray
    y: np.ndarray

    def weights(self, upto: int) -> np.ndarray:
        """Balanced weights of both classes over the first ``upto`` rows."""
        n1 = int(self.y[:upto].sum())
        n0 = upto - n1
        if not n0 or not n1:
            raise ValueError("training rows hold one class only")
        return np.array([upto / (2 * n0), upto / (2 * n1)])


def fits_in_tasks(train: DataFrame, width: int, most: int = MOST_CELLS) -> bool:
    return train.count() * (width + 2) <= most


def collect_rows(train: DataFrame, label: str, date_col: str = "trade_date") -> Rows:
    """The rows of a frame that ``fits_in_tasks``."""
    table = train.select(date_col, F.col(label).cast("double").alias("y"), vector_to_array("features").alias("x")).toArrow()
    order = np.argsort(table.column(0).to_numpy(), kind="stable")
    x = np.array(table.column("x").to_pylist(), float).reshape(len(order), -1)
    return Rows(x[order], table.column("y").to_numpy()[order].astype(np.int64))


def fold_bounds(n: int, k: int) -> list[tuple[int, int]]:
    """(first test row, end of the test rows) per fold; every earlier row is a training row."""
    size = n // (k + 1)
    return [(n - (k - i) * size, n - (k - i - 1) * size) for i in range(k)]


# -- trees ----------------------------------------------------------------------------------------
@dataclass
class Trees:
    """Nodes of several trees, level by level; the first ``n`` are the roots. A leaf's ``feature`` is -1."""

    n: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rows: np.ndarray
    class_weight: np.ndarray
    gain: np.ndarray
    tree: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit number for each number."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def features_per_split(rule: str, width: int) -> int:
    return max(1, int(math.sqrt(width) if rule == "sqrt" else math.log2(width)))


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: Sequence[int], rule: str, seed: int, max_depth: int = MAX_DEPTH, min_split: int = 2) -> Trees:
    """The trees with the given numbers, on bootstrap samples of the rows; ``w`` weighs the two classes.

    Sums run over counts, which are exact, so a tree is the same whatever trees are grown beside it.
    """
    n, width = x.shape
    drawn = features_per_split(rule, width)
    values = [np.unique(x[:, f]) for f in range(width)]
    rank = np.stack([np.searchsorted(v, x[:, f]) for f, v in enumerate(values)], axis=1)
    tree_of, row_of, times = [], [], []
    for k, tree in enumerate(trees):
        counts = np.bincount(np.random.default_rng([seed, tree]).integers(0, n, n), minlength=n)
        at = np.flatnonzero(counts)
        tree_of.append(np.full(len(at), k))
        row_of.append(at)
        times.append(counts[at])
    node, row = np.concatenate(tree_of), np.concatenate(row_of)
    times = np.concatenate(times).astype(float)
    weight = np.stack([times * (y[row] == 0), times * (y[row] == 1)], axis=1)
    key = _mix(np.array(trees, np.uint64) + _mix(np.array([seed + 1], np.uint64)))
    out: dict[str, list] = {c: [] for c in ("feature", "threshold", "left", "right", "rows", "class_weight", "gain", "tree")}
    owner, made = np.arange(len(trees)), len(trees)
    for depth in range(max_depth + 1):
        open_nodes = len(key)
        rows = np.bincount(node, minlength=open_nodes)
        counts = np.stack([np.bincount(node, weight[:, c], open_nodes) for c in (0, 1)], axis=1)
        sums = counts * w
        growing = (sums.min(axis=1) > 0) & (rows >= max(2, min_split)) & (depth < max_depth)
        with np.errstate(over="ignore"):
            lots = _mix(key[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        choice = np.argsort(lots, axis=1, kind="stable")[:, :drawn]
        best = np.full(open_nodes, -np.inf)
        feature, cut = np.full(open_nodes, -1), np.zeros(open_nodes, np.int64)
        active = growing[node]
        node, row, weight = node[active], row[active], weight[active]
        for slot in range(drawn if len(node) else 0):
            f = choice[:, slot]
            r = rank[row, f[node]]
            order = np.argsort(node * (n + 1) + r, kind="stable")
            by, r = node[order], r[order]
            first = np.flatnonzero(np.diff(by, prepend=-1))
            run = np.cumsum(weight[order], axis=0)
            before = np.zeros((open_nodes, 2))
            before[by[first]] = run[first] - weight[order][first]
            left = run - before[by]
            left, right = left * w, (counts[by] - left) * w
            parted = np.append((by[1:] == by[:-1]) & (r[1:] != r[:-1]), False)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = (left**2).sum(axis=1) / left.sum(axis=1) + (right**2).sum(axis=1) / right.sum(axis=1)
            score[~parted] = -np.inf
            top = np.maximum.reduceat(score, first)
            hits = np.flatnonzero((score == np.repeat(top, np.diff(np.append(first, len(by))))) & parted)
            winner = hits[np.flatnonzero(np.diff(by[hits], prepend=-1))]
            better = winner[score[winner] > best[by[winner]]]
            best[by[better]], feature[by[better]], cut[by[better]] = score[better], f[by[better]], r[better]
        split = feature >= 0
        number = np.cumsum(split) - 1
        left_id = np.where(split, made + 2 * number, -1)
        total = sums.sum(axis=1)
        threshold = np.zeros(open_nodes)
        for f in np.unique(feature[split]):
            mine = split & (feature == f)
            # The next value in the node may lie further up; half way to it is where the rows part.
            threshold[mine] = values[f][cut[mine]]
        if split.any():
            r = rank[row, np.maximum(feature[node], 0)]
            goes_right = r > cut[node]
            above = np.full(open_nodes, n + 1)
            np.minimum.at(above, node[goes_right & split[node]], r[goes_right & split[node]])
            for f in np.unique(feature[split]):
                mine = split & (feature == f)
                threshold[mine] = (threshold[mine] + values[f][above[mine]]) / 2
        gain = np.where(split, (best - (sums**2).sum(axis=1) / np.where(total > 0, total, 1)) / np.where(total > 0, total, 1), -1.0)
        for name, column in (("feature", feature), ("threshold", threshold), ("left", left_id), ("right", np.where(split, left_id + 1, -1)), ("rows", rows), ("class_weight", sums), ("gain", gain), ("tree", owner)):
            out[name].append(column)
        if not split.any():
            break
        inside = split[node]
        node, row, weight, goes_right = node[inside], row[inside], weight[inside], goes_right[inside]
        node = 2 * number[node] + goes_right
        with np.errstate(over="ignore"):
            key = _mix(np.repeat(key[split], 2) * np.uint64(2) + np.tile(np.array([1, 2], np.uint64), int(split.sum())))
        owner = np.repeat(owner[split], 2)
        made += 2 * int(split.sum())
    return Trees(len(trees), *(np.concatenate(out[c]) for c in ("feature", "threshold", "left", "right", "rows", "class_weight", "gain", "tree")))


def cut_scores(trees: Trees, x: np.ndarray, depths: Sequence[int], min_splits: Sequence[int]) -> dict[tuple[int, int], np.ndarray]:
    """Per (depth, minimum split): the class-1 share of the cut tree's leaf, by tree and row."""
    at = np.tile(np.arange(trees.n)[:, None], (1, len(x)))
    share = trees.class_weight[:, 1] / trees.class_weight.sum(axis=1)
    here = {s: share[at] for s in min_splits}
    going = {s: np.ones(at.shape, bool) for s in min_splits}
    out, column = {}, np.arange(len(x))[None, :]
    for level in range(max(depths) + 1):
        if level in depths:
            out.update({(level, s): here[s].copy() for s in min_splits})
        inner = trees.feature[at] >= 0
        if not inner.any():
            break
        value = x[column, np.maximum(trees.feature[at], 0)]
        below = np.where(value <= trees.threshold[at], trees.left[at], trees.right[at])
        for s in min_splits:
            going[s] &= inner & (trees.rows[at] >= s)
            here[s] = np.where(going[s], share[below], here[s])
        at = np.where(inner, below, at)
    for d in depths:
        for s in min_splits:
            out.setdefault((d, s), here[s])
    return out


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the curve, ties half; NaN where a class is missing."""
    pos = int(y.sum())
    if not pos or pos == len(y):
        return math.nan
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    return float((ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


# -- search and model -----------------------------------------------------------------------------
def _depth(setting: dict) -> int:
    return setting.get("max_depth") or MAX_DEPTH


def nested_search(spark, rows: Rows, settings: Sequence[dict], folds: int, seed: int, per_task: int = TREES_PER_TASK) -> tuple[dict, DataFrame]:
    """Best setting by mean ROC AUC over time-ordered folds, and the score table, as the plain search returns them."""
    rules = sorted({s.get("max_features", "sqrt") for s in settings})
    depths = sorted({_depth(s) for s in settings})
    splits = sorted({s.get("min_samples_split", 2) for s in settings})
    prefixes = sorted({s.get("n_estimators", 100) for s in settings})
    bounds = fold_bounds(len(rows.y), folds)
    usable = [0 < rows.y[:a].sum() < a and 0 < rows.y[a:b].sum() < b - a for a, b in bounds]
    # A batch never spans a prefix, so a prefix is a sum of batches.
    edges = sorted({0, *prefixes, *range(0, prefixes[-1], per_task)})
    tasks = [(rule, k, a, b) for rule in rules for k in range(folds) if usable[k] for a, b in zip(edges, edges[1:])]
    cells = {}
    if tasks:
        x, y, weights = rows.x, rows.y, [rows.weights(a) if ok else None for (a, _), ok in zip(bounds, usable)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t in batch.to_pylist():
                    a, b = bounds[t["fold"]]
                    grown = grow(x[:a], y[:a], weights[t["fold"]], range(t["low"], t["high"]), t["rule"], seed, max(depths), min(splits))
                    sums = cut_scores(grown, x[a:b], depths, splits)
                    rows_out = [(t["rule"], t["fold"], d, s, t["low"], v.sum(axis=0).tolist()) for (d, s), v in sums.items()]
                    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_out), types)], names=["rule", "fold", "depth", "split", "low", "sums"])

        def score(group: pa.Table) -> pa.Table:
            g = sorted(group.to_pylist(), key=lambda r: r["low"])
            a, b = bounds[g[0]["fold"]]
            out = [(g[0]["rule"], g[0]["fold"], g[0]["depth"], g[0]["split"], n, auc(y[a:b], np.sum([r["sums"] for r in g if r["low"] < n], axis=0) / n)) for n in prefixes]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            return pa.table([pa.array(c, k) for c, k in zip(zip(*out), types)], names=["rule", "fold", "depth", "split", "trees", "auc"])

        frame = spark.createDataFrame(tasks, "rule string, fold int, low int, high int").repartition(len(tasks), "rule", "fold", "low")
        parts = frame.mapInArrow(run, "rule string, fold int, depth int, split int, low int, sums array<double>")
        scored = parts.groupBy("rule", "fold", "depth", "split").applyInArrow(score, "rule string, fold int, depth int, split int, trees int, auc double")
        cells = {tuple(r)[:5]: r.auc for r in scored.collect()}
    table = [
        (i, str(s), k + 1, cells.get((s.get("max_features", "sqrt"), k, _depth(s), s.get("min_samples_split", 2), s.get("n_estimators", 100)), math.nan))
        for i, s in enumerate(settings)
        for k in range(folds)
    ]
    means = [sum(r[3] for r in table if r[0] == i) / folds for i in range(len(settings))]
    best = max(range(len(settings)), key=lambda i: (-math.inf if math.isnan(means[i]) else means[i], -i))
    return settings[best], spark.createDataFrame(table, "setting int, params string, fold int, auc double")


_NODE = "struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"


def _saved_nodes(trees: Trees, numbers: Sequence[int]) -> Iterator[tuple[int, dict]]:
    """Nodes in the layout of a saved forest: numbered from 0 in each tree, children behind their parent."""
    place = np.empty(len(trees.tree), np.int64)
    for k in range(trees.n):
        mine = np.flatnonzero(trees.tree == k)
        place[mine] = np.arange(len(mine))
    for i in range(len(trees.tree)):
        w = trees.class_weight[i]
        inner = trees.feature[i] >= 0
        p = w / w.sum()
        split = {"featureIndex": int(trees.feature[i]), "leftCategoriesOrThreshold": [float(trees.threshold[i])] if inner else [], "numCategories": -1}
        children = [int(place[c]) if inner else -1 for c in (trees.left[i], trees.right[i])]
        yield numbers[trees.tree[i]], {
            "id": int(place[i]), "prediction": float(w[1] > w[0]), "impurity": float(1 - (p * p).sum()), "impurityStats": w.tolist(),
            "rawCount": int(trees.rows[i]), "gain": float(trees.gain[i]), "leftChild": children[0], "rightChild": children[1], "split": split,
        }


def fit_forest(spark, rows: Rows, setting: dict, seed: int, template: RandomForestClassifier, sample: DataFrame, per_task: int = TREES_PER_TASK) -> RandomForestClassificationModel:
    """A Spark forest with one setting, grown on all rows.

    ``template`` fits one tree of depth 1 on ``sample``: its saved form gives the columns' names and
    metadata, and the grown nodes take the place of its own.
    """
    n, rule = setting.get("n_estimators", 100), setting.get("max_features", "sqrt")
    x, y, w = rows.x, rows.y, rows.weights(len(rows.y))
    depth, least = _depth(setting), setting.get("min_samples_split", 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                numbers = range(t["low"], t["high"])
                out = list(_saved_nodes(grow(x, y, w, numbers, rule, seed, depth, least), numbers))
                yield pa.RecordBatch.from_pylist([{"treeID": k, "nodeData": node} for k, node in out], schema=_ARROW_NODES)

    tasks = [(a, min(a + per_task, n)) for a in range(0, n, per_task)]
    frame = spark.createDataFrame(tasks, "low int, high int").repartition(len(tasks), "low")
    small, path = work_path(spark, "forest-template"), work_path(spark, "forest")
    template.copy().setNumTrees(1).setMaxDepth(1).fit(sample).save(small)
    frame.mapInArrow(run, f"treeID int, nodeData {_NODE}").write.parquet(f"{path}/data")
    tree = spark.read.parquet(f"{small}/treesMetadata")
    tree.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_1"), "_2", "_3").coalesce(1).write.parquet(f"{path}/treesMetadata")
    about = json.loads(spark.read.text(f"{small}/metadata").first()[0])
    about["numTrees"] = n
    about["paramMap"].update(numTrees=n, maxDepth=depth)
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)


_ARROW_NODES = pa.schema([
    ("treeID", pa.int32()),
    ("nodeData", pa.struct([
        ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
        ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
        ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])),
    ])),
])

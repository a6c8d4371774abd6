"""Model plans on small separable series; time order and persistence."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from bellwire.operators.features import FeatureSpec, feature_frame
from bellwire.operators.sequence import number_rows
from bellwire.plans import experiments as ex, forests, logistic as lg, models as ml
from bellwire.plans.networks import Network
from bellwire.registry import models as registry
from bellwire.sources.prices import add_returns

DATES = {"train": ("2020-01-01", "2020-06-30"), "test": ("2020-07-01", "2020-12-31")}


@pytest.fixture(scope="module")
def daily(spark):
    """240 days whose rise or fall follows the sentiment exactly, with some sentiment missing."""
    rows = []
    for i in range(240):
        up = (i * 7 % 5) < 2
        s = None if i % 29 == 0 else (0.4 if up else -0.4) + (i % 3) / 100
        rows.append((date(2020, 1, 1) + timedelta(days=i), 100.0, 101.0 + i % 4 if up else 99.0 - i % 3, s, s))
    df = spark.createDataFrame(rows, "trade_date date, open_price double, close_price double, avg_sentiment double, avg_sentiment_x double")
    return add_returns(df).cache()


@pytest.mark.parametrize("family, grid", [("lr", {"C": [0.1, 1.0], "l1_ratio": [0.0]}), ("rf", {"n_estimators": [10], "max_depth": [3]}), ("gbt", {"n_estimators": [5]})])
def test_families_learn_a_separable_series(spark, daily, family, grid):
    fitted = ml.fit_family(daily, family, "consolidated", ["avg_sentiment"], grid=grid, folds=3, **DATES)
    m = fitted.metrics().first()
    assert m.auc > 0.9 and 0 <= m.accuracy <= 1 and m.n > 40
    preds = fitted.predict().collect()
    assert all(0 <= p.predicted_proba <= 1 and p.predicted_label == int(p.predicted_proba >= 0.5) for p in preds)
    assert fitted.top_importances(3).count() <= 3


def test_logistic_penalty_mapping():
    est = ml.logistic({"C": 0.5, "l1_ratio": 0.25}, 200.0)
    assert math.isclose(est.getRegParam(), 0.01) and est.getElasticNetParam() == 0.25 and not est.getStandardization()


def test_default_grids_have_the_full_size():
    sizes = {(f, v): len(ml.expand_grid(g)) for f, fam in ml.FAMILIES.items() for v, g in fam.grids.items()}
    assert sizes["lr", "baseline"] == 20 and sizes["rf", "baseline"] == 36 and sizes["rf", "sources"] == 48 and sizes["gbt", "baseline"] == 1


def test_reloaded_model_predicts_the_same_from_unscaled_rows(daily, tmp_path):
    fitted = ml.fit_family(daily, "lr", "consolidated", ["avg_sentiment"], grid={"C": [1.0], "l1_ratio": [0.0]}, **DATES)
    again = ml.load_model(fitted.save(str(tmp_path / "m")))
    spec = FeatureSpec(**{**ml.FAMILIES["lr"].spec["consolidated"], "sentiment": ("avg_sentiment",), **DATES})
    rows = feature_frame(daily, spec)[0].where("split = 'test'")
    a = [r.predicted_proba for r in fitted.predict().orderBy("trade_date").collect()]
    b = [float(r.probability[1]) for r in again.transform(rows).orderBy("trade_date").collect()]
    assert len(a) > 40 and a == b


@pytest.mark.parametrize(
    "family, grid, spec",
    [
        ("lr", {"C": [1.0], "l1_ratio": [0.0]}, {}),
        ("lr", {"C": [1.0], "l1_ratio": [0.0]}, {"lags_from": "prices", "lag_nulls": "impute", "impute_scope": "all"}),
        ("rf", {"n_estimators": [5], "max_depth": [3]}, {}),
    ],
)
def test_whole_artefact_scores_raw_days_as_the_features_do(spark, daily, tmp_path, family, grid, spec):
    """Missing sentiment, a zero open, a day without label, and the coming day."""
    odd = daily.withColumn("open_price", F.when(F.dayofyear("trade_date") == 190, 0.0).otherwise(F.col("open_price")))
    odd = odd.withColumn("close_price", F.when(F.dayofyear("trade_date") != 200, F.col("close_price")))
    odd = add_returns(odd.select("trade_date", "open_price", "close_price", "avg_sentiment")).withColumn("extra", F.lit("x"))
    fitted = ml.fit_family(odd, family, "consolidated", ["avg_sentiment"], grid=grid, **{**DATES, **spec})
    again = ml.load_model(fitted.save_whole(str(tmp_path / "whole")))
    coming = spark.createDataFrame([(date(2021, 1, 1),)], "trade_date date")
    raw = odd.unionByName(coming, allowMissingColumns=True)
    got = {r.trade_date: float(r.probability[1]) for r in again.transform(raw).collect()}
    want = {r.trade_date: r.predicted_proba for r in fitted.predict().collect()}
    assert len(want) > 40 and {d: got[d] for d in want} == want
    assert 0 <= got[date(2021, 1, 1)] <= 1
    features = again.stages[0].transform(raw).where("trade_date = date'2021-01-01'").first()
    returns = [r.daily_return for r in odd.where("daily_return is not null").orderBy(F.desc("trade_date")).limit(3).collect()]
    assert [features[f"prev_return_t-{k}"] for k in (1, 2, 3)] == pytest.approx(returns)


def test_logistic_runs_use_five_lags(daily):
    for variant, spec in ml.FAMILIES["lr"].spec.items():
        names = feature_frame(daily, FeatureSpec(**{**spec, "sentiment": ("avg_sentiment",), **DATES}))[1]
        lags = ["5" in n for n in names]
        assert sum(lags) >= 2 and spec["n_lags"] == 5, variant


def assembled(daily, n_lags=2):
    frame, names = feature_frame(daily, FeatureSpec(sentiment=("avg_sentiment",), n_lags=n_lags, with_interactions=False, **DATES))
    assembler, ready = ml._assembled(frame.where("split = 'train'"), names)
    return assembler.transform(ready).select("trade_date", ml.LABEL, "features").cache(), len(names)


def test_batched_logistic_fits_are_optimal_and_equal_single_fits(spark, daily):
    train, width = assembled(daily)
    rows = lg.positioned(number_rows(train, ["trade_date"], out="n").repartition(3), F.col("n") - 1, ml.LABEL)
    table = rows.toPandas().sort_values("at")
    x, y = np.stack(table.x), table.y.to_numpy()
    problems = [lg.Problem(before, 1.0, 1.5, c, l1) for before in (60, 120, len(y)) for c in (0.01, 1.0, 50.0) for l1 in (0.0, 0.5, 1.0)]
    found = lg.fit_many(rows, width, problems)
    for p, b in zip(problems, found):
        w = np.where(y == 1, p.weight1, p.weight0) * (table["at"].to_numpy() < p.before)
        wrong = w * (1 / (1 + np.exp(-(x @ b[:-1] + b[-1]))) - y)
        slope = p.c * (x.T @ wrong) + (1 - p.l1) * b[:-1]
        # Zero gradient, up to the sign rule of the l1 part.
        assert abs(p.c * wrong.sum()) < 1e-6
        assert np.where(b[:-1] != 0, np.abs(slope + p.l1 * np.sign(b[:-1])), np.maximum(np.abs(slope) - p.l1, 0)).max() < 1e-6
    one = ml.logistic({"C": 1.0, "l1_ratio": 0.5}, 1.0 * (y == 0).sum() + 1.5 * (y == 1).sum()).setTol(1e-12)
    single = one.fit(train.withColumn(ml.WEIGHT, F.when(F.col(ml.LABEL) == 1, 1.5).otherwise(1.0)))
    mine = found[problems.index(lg.Problem(len(y), 1.0, 1.5, 1.0, 0.5))]
    assert np.abs(np.append(single.coefficients.toArray(), single.intercept) - mine).max() < 1e-4


def test_logistic_search_equals_the_plain_search(daily):
    train, width = assembled(daily)
    settings = ml.expand_grid({"C": [0.05, 1.0], "l1_ratio": [0.0, 0.5]})
    best, table = ml.logistic_search(train, width, settings, folds=3)
    plain_best, plain = ml.ts_grid_search(train, ml.logistic, settings, folds=3)
    a, b = ({(r.setting, r.fold): r.auc for r in t.collect()} for t in (table, plain))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.02 for k in a) and best in settings
    one_class = train.where(f"{ml.LABEL} = 1")
    assert all(math.isnan(r.auc) for r in ml.logistic_search(one_class, width, settings, folds=3)[1].collect())


def forest_rows(n=400, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, d)), 1)
    return forests.Rows(x, (x[:, 0] + rng.standard_normal(n) > 0).astype(int))


def walk(trees, k, row):
    """Node by node down one tree."""
    at, path = k, [k]
    while trees.feature[at] >= 0:
        at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        path.append(at)
    return path


def test_cut_trees_equal_trees_grown_to_the_cut_and_scoring_node_by_node():
    rows = forest_rows()
    w = rows.weights(300)
    full = forests.grow(rows.x[:300], rows.y[:300], w, range(6), "sqrt", 7)
    cuts = forests.cut_scores(full, rows.x[300:], [2, 5, 30], [2, 8])
    for (depth, least), got in cuts.items():
        small = forests.grow(rows.x[:300], rows.y[:300], w, range(6), "sqrt", 7, depth, least)
        again = forests.cut_scores(small, rows.x[300:], [30], [2])[30, 2]
        assert np.allclose(got, again)
        for k in range(6):
            for j, row in enumerate(rows.x[300:]):
                path = walk(full, k, row)
                stop = next((i for i, node in enumerate(path) if i == depth or full.rows[node] < least), len(path) - 1)
                a, b = full.class_weight[path[stop]]
                assert got[k, j] == pytest.approx(b / (a + b))
    # A tree does not depend on the trees grown beside it.
    alone = forests.grow(rows.x[:300], rows.y[:300], w, [4], "sqrt", 7)
    assert (alone.threshold == full.threshold[full.tree == 4]).all()


def test_root_split_has_the_best_gain():
    rows = forest_rows(60, 3, 2)
    trees = forests.grow(rows.x, rows.y, rows.weights(60), range(20), "log2", 1, 1)
    for k in range(20):
        counts = np.bincount(np.random.default_rng([1, k]).integers(0, 60, 60), minlength=60) * rows.weights(60)[rows.y]
        f, cut = trees.feature[k], trees.threshold[k]

        def score(t):
            parts = [counts[(rows.x[:, f] <= t) & (rows.y == c)].sum() for c in (0, 1)], [counts[(rows.x[:, f] > t) & (rows.y == c)].sum() for c in (0, 1)]
            return sum((a * a + b * b) / (a + b) for a, b in parts if a + b)

        assert score(cut) == pytest.approx(max(score(t) for t in np.unique(rows.x[:, f])))


def test_nested_search_and_the_spark_forest(spark):
    rows = forest_rows(240, 4, 3)
    settings = ml.expand_grid({"n_estimators": [10, 30], "max_depth": [2, None], "min_samples_split": [2, 10], "max_features": ["sqrt", "log2"]})
    best, table = forests.nested_search(spark, rows, settings, 3, 5, per_task=8)
    got = {(r.setting, r.fold): r.auc for r in table.collect()}
    for i in (0, 5, 11, 15):
        s = settings[i]
        for k, (a, b) in enumerate(forests.fold_bounds(240, 3), 1):
            grown = forests.grow(rows.x[:a], rows.y[:a], rows.weights(a), range(s["n_estimators"]), s["max_features"], 5, s["max_depth"] or 30, s["min_samples_split"])
            mean = forests.cut_scores(grown, rows.x[a:b], [30], [2])[30, 2].mean(axis=0)
            assert got[i, k] == pytest.approx(forests.auc(rows.y[a:b], np.round(mean, 12)), abs=0.01)
    frame = spark.createDataFrame([(Vectors.dense(v), int(y), 1.0) for v, y in zip(rows.x, rows.y)], ["features", ml.LABEL, ml.WEIGHT])
    model = forests.fit_forest(spark, rows, best, 5, ml.forest(best, 240.0), frame, per_task=8)
    grown = forests.grow(rows.x, rows.y, rows.weights(240), range(best["n_estimators"]), best["max_features"], 5, best["max_depth"] or 30, best["min_samples_split"])
    want = forests.cut_scores(grown, rows.x, [30], [2])[30, 2].mean(axis=0)
    theirs = [float(r.probability[1]) for r in model.transform(frame.coalesce(1)).collect()]
    assert np.allclose(theirs, want) and len(model.trees) == best["n_estimators"] and abs(model.featureImportances.toArray().sum() - 1) < 1e-9


def test_auc_equals_counting_pairs():
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 6, 80)
    wins = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    assert forests.auc(y, s) == pytest.approx(np.mean(wins)) and math.isnan(forests.auc(np.ones(3), np.arange(3)))


def test_network_gradient_and_refits(spark, daily):
    rng = np.random.default_rng(1)
    x, y, net = rng.standard_normal((30, 3)), rng.integers(0, 2, 30).astype(float), Network(4, 50)
    at = net.train(x, y)
    loss = lambda w: -np.mean(y * np.log(net.predict(w, x)) + (1 - y) * np.log(1 - net.predict(w, x)))
    for part, g in zip(range(4), net.gradient(at, x, y)):
        moved = [a.copy() for a in at]
        moved[part].flat[0] += 1e-6
        assert (loss(moved) - loss(at)) / 1e-6 == pytest.approx(g.flat[0], abs=1e-4)
    frame, names = feature_frame(daily, FeatureSpec(sentiment=("avg_sentiment",), n_lags=1, with_interactions=False, **DATES))
    out = ml.walk_forward_network(frame, names, "2020-01-01", "2020-07-01", "2020-07-06", Network(8, 60), refit_every=2).orderBy("trade_date").collect()
    assert [r.trade_date for r in out] == [date(2020, 7, d) for d in range(1, 7)]
    assert sum(r.predicted_label == r.actual_increase for r in out) >= 5
    # Later rows change nothing about an earlier day's prediction.
    cut = frame.where("trade_date <= '2020-07-02'")
    again = ml.walk_forward_network(cut, names, "2020-01-01", "2020-07-01", "2020-07-02", Network(8, 60), refit_every=2).orderBy("trade_date").collect()
    assert [round(r.predicted_proba, 5) for r in again] == [round(r.predicted_proba, 5) for r in out[:2]]


def test_batched_walk_forward_equals_single_fits(spark, daily):
    frame, names = feature_frame(daily, FeatureSpec(sentiment=("avg_sentiment",), n_lags=3, with_interactions=False, **DATES))

    def estimator(weight_sum):
        return LogisticRegression(labelCol=ml.LABEL, weightCol=ml.WEIGHT, regParam=1.0 / weight_sum, maxIter=1000, tol=1e-12, standardization=False)

    dates = ("2020-01-01", "2020-07-01", "2020-07-04")
    one = ml.walk_forward(frame, names, estimator, *dates).orderBy("trade_date").collect()
    many = ml.walk_forward_logistic(frame, names, *dates).orderBy("trade_date").collect()
    assert [(r.trade_date, r.actual_increase) for r in one] == [(r.trade_date, r.actual_increase) for r in many]
    assert all(abs(a.predicted_proba - b.predicted_proba) < 1e-6 for a, b in zip(one, many))
    with pytest.raises(ValueError):
        ml.walk_forward_logistic(frame, names, "2020-06-30", "2020-07-01", "2020-07-02")


def test_one_class_training_is_refused(daily):
    with pytest.raises(ValueError):
        ml.weigh(daily.where("increase = 1"), "balanced")


def test_walk_forward_trains_on_earlier_days_only(spark, daily):
    spec = FeatureSpec(sentiment=("avg_sentiment",), n_lags=1, with_interactions=False, **DATES)
    frame, names = feature_frame(daily, spec)
    seen = []

    def estimator(weight_sum):
        seen.append(weight_sum)
        return LogisticRegression(labelCol=ml.LABEL, weightCol=ml.WEIGHT, maxIter=10)

    out = ml.walk_forward(frame, names, estimator, "2020-01-01", "2020-07-01", "2020-07-05", parallelism=1)
    rows = out.orderBy("trade_date").collect()
    assert [r.trade_date for r in rows] == [date(2020, 7, d) for d in range(1, 6)]
    # Balanced weights sum to the training rows: one more per refit.
    assert [round(s) for s in seen] == [round(seen[0]) + i for i in range(5)]
    with pytest.raises(ValueError):
        ml.walk_forward(frame, names, estimator, "2020-06-30", "2020-07-01", "2020-07-02", parallelism=1)


def test_experiment_matrix_rows(daily):
    runs = ex.matrix(("lr",), ("s",))
    assert [(r.variant, r.scorer) for r in runs] == [("baseline", ""), ("consolidated", "s"), ("sources", "s")]
    out = ex.run_matrix(daily, runs, ["x"], {"s": "avg_sentiment"}, {"lr": {"grid": {"C": [1.0], "l1_ratio": [0.0]}}}, **DATES).collect()
    assert len(out) == 3 and len({r.variant for r in out}) == 3


class Stopped(Exception):
    pass


@pytest.mark.parametrize(
    "name, where",
    [(q, "fit_family") for q in ("rf_baseline", "rf_consolidated", "rf_sources", "top_importances", "predictions_csv", "model_roundtrip")]
    + [("experiment_matrix", "run_matrix"), ("walk_forward", "walk_forward_logistic"), ("attention_classifier", "walk_forward_network"), ("embedding_forest", "embedding_forest")],
)
def test_registered_model_queries_cut_nothing(spark, sf_dir, monkeypatch, name, where):
    """Grids, trees, refits, hidden units and steps are the library's defaults."""
    seen = []

    def stop(*args, **kw):
        seen.append((args, kw))
        raise Stopped

    for module in (registry.ml, registry.ex, registry.dv):
        if hasattr(module, where):
            monkeypatch.setattr(module, where, stop)
    with pytest.raises(Stopped):
        registry.ENTRIES[name].run(spark, sf_dir)
    (args, kw), = seen
    assert not {"grid", "folds", "refit_every", "trees", "options", "scorers", "network"} & set(kw)
    assert (Network().hidden, Network().steps) == (64, 100)
    if name == "walk_forward":
        assert len(args[1]) == 3
    if name == "experiment_matrix":
        daily, runs, sources = args
        assert runs == ex.matrix() and len(runs) == 33
        for r in runs:
            assert r.variant == "baseline" or ex.SCORERS[r.scorer] in daily.columns
            assert r.variant != "sources" or len(registry.ft.select_source_columns(daily.columns, ex.SCORERS[r.scorer], sources)) == 5


def test_numbering_of_a_short_series_makes_as_many_ranges_as_it_has_partitions(spark, daily, monkeypatch):
    from bellwire.operators import sequence

    seen = []
    plain = sequence._range_placed
    monkeypatch.setattr(sequence, "_range_placed", lambda df, order, n: seen.append(n) or plain(df, order, n))
    ml.fit_family(daily, "lr", "baseline", grid={"C": [0.1, 1.0], "l1_ratio": [0.0]}, **DATES).metrics().collect()
    # One for the folds and one for the AUC; before, both used the shuffle partitions of the session.
    assert seen == [1, 1]

"""Day means, bags, pooling, softmax, correlation, regression and metrics against plain Python."""

import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from bellwire import fixtures as fx
from bellwire.operators import aggregates as ag, features as ft, stats as st
from bellwire.sources import prices as px


def day(n):
    return date(2024, 1, n)


def prices(spark, days):
    rows = [(day(d), 10.0, 11.0) for d in days]
    return spark.createDataFrame(rows, "trade_date date, open_price double, close_price double")


def news(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, ts timestamp_ntz, score string")


def test_daily_means_ignore_junk_and_count_null_sources_in_the_total(spark):
    at = datetime(2024, 1, 3, 2, 0)
    rows = [(1, "a.b-c d", at, "1.0"), (2, None, at, "3.0"), (3, "x", at, "junk"), (4, "x", at, "NaN"), (5, "a.b-c d", at, None)]
    out = ag.aggregate_daily(prices(spark, [2, 3, 4]), news(spark, rows), F.col("ts"), {"score": "avg_sentiment_lm"})
    got = {r.trade_date.day: r for r in out.collect()}
    assert got[3].avg_sentiment_lm == 2.0 and got[3]["avg_sentiment_lm_a_b_c_d"] == 1.0 and got[3]["avg_sentiment_lm_x"] is None
    assert got[2].avg_sentiment_lm is None and got[4].avg_sentiment_lm is None


def test_bags_split_a_hot_group_into_bounded_chunks(spark):
    df = spark.range(1000).select("id", F.expr("if(id < 900, 'hot', 'cold')").alias("g"), (F.col("id") * 2).alias("v"))
    chunks = ag.bag_by_group(df.repartition(7), "g", "id", "v", max_items=250).collect()
    assert all(r.n_items == len(r["items"]) <= 250 for r in chunks)
    hot = [i.id for r in sorted((r for r in chunks if r.g == "hot"), key=lambda r: r.chunk) for i in r["items"]]
    assert hot == list(range(900))


def test_top_norms_are_ascending_and_padded(spark):
    df = spark.createDataFrame([(1, "a", [3.0, 4.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0, 0.0]), (4, "a", [6.0, 8.0]), (5, "a", [0.0, 2.0])], "id long, g string, v array<double>")
    got = {r.g: r.top_norms for r in ag.top_norms(df, "g", "id", "v").collect()}
    assert got == {"a": [2.0, 5.0, 10.0], "b": [0.0, 0.0, 1.0]}


def test_pooling_and_attention_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, rng.normal(size=4).tolist(), float(rng.normal() * 30)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, g long, v array<double>, s double").repartition(5)
    pooled = {r.g: r for r in ag.pool_vectors(df, "g", "v").collect()}
    attended = {r.g: r.pooled for r in ag.attention_pool(df, "g", "s", "v").collect()}
    weights = {r.id: r.weight for r in ag.softmax_weights(df, "g", "s").collect()}
    for g in range(3):
        m = np.array([r[2] for r in rows if r[1] == g])
        s = np.array([r[3] for r in rows if r[1] == g])
        w = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert np.allclose(pooled[g].vec_mean, m.mean(0)) and np.allclose(pooled[g].vec_max, m.max(0)) and np.allclose(pooled[g].vec_min, m.min(0))
        assert np.allclose(attended[g], w @ m)
        assert np.allclose([weights[r[0]] for r in rows if r[1] == g], w)


def test_corr_is_pairwise_complete_and_null_for_constants(spark):
    data = [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 5.0, 5.0), (None, 1.0, 5.0), (4.0, 9.0, 5.0), (float("nan"), 3.0, 5.0)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = {(r.col_a, r.col_b): r["corr"] for r in st.corr_matrix(df, ["a", "b", "c"]).collect()}
    want = np.corrcoef([1, 3, 4], [2, 5, 9])[0, 1]
    assert len(got) == 9 and math.isclose(got["a", "b"], want) and got["a", "b"] == got["b", "a"]
    assert math.isclose(got["a", "a"], 1.0) and got["a", "c"] is None and got["c", "c"] is None


def test_linregress_and_p_value(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=40)
    y = 2 * x + 1 + rng.normal(size=40)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double")
    r = st.linregress(df, "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    res = y - slope * x - intercept
    stderr = math.sqrt((res @ res) / 38 / ((x - x.mean()) ** 2).sum())
    assert r.n == 40 and math.isclose(r.slope, slope) and math.isclose(r.intercept, intercept) and math.isclose(r.stderr, stderr)
    assert st.linregress_p_value(df, "x", "y") < 1e-6
    flat = st.linregress(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()
    assert flat.slope is None and flat.r_value is None


def brute_tail(t, v, steps=200_000):
    """Simpson's rule over the angle atan(t / sqrt(v))."""
    def area(low):
        angle = np.linspace(low, math.pi / 2, steps + 1)
        weight = np.where(np.arange(steps + 1) % 2 == 1, 4.0, 2.0)
        weight[[0, -1]] = 1.0
        return (weight * np.maximum(np.cos(angle), 0) ** (v - 1)).sum() * (math.pi / 2 - low) / steps / 3
    return area(math.atan(abs(t) / math.sqrt(v))) / area(0.0)


def test_t_tail_equals_closed_forms_and_integration(spark):
    cases = [(t, v) for t in (0.0, 1e-6, 0.3, -1.0, 2.5, 7.0, 40.0) for v in (1, 2, 3, 4, 7, 30, 599, 12_345)]
    cases += [(t, 4_000_000) for t in (0.01, 1.0, -3.0, 6.0)] + [(None, 5), (1.0, 0), (1.0, -1), (1.0, None), (math.inf, 5)]
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(cases)], "i int, t double, v long")
    got = {r.i: r.p for r in df.select("i", st.t_two_sided(F.col("t"), F.col("v")).alias("p")).collect()}
    for i, (t, v) in enumerate(cases):
        if t is None or v is None or v <= 0:
            assert got[i] is None
        elif math.isinf(t):
            assert got[i] == 0.0
        else:
            closed = {1: 1 - 2 / math.pi * math.atan(abs(t)), 2: 1 - abs(t) / math.sqrt(2 + t * t)}
            if v > 1_000_000:
                # Powers of cosines lose digits here; the normal tail with its first correction does not.
                density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
                want = math.erfc(abs(t) / math.sqrt(2)) + density * (abs(t) ** 3 + abs(t)) / (2 * v)
            else:
                want = closed[v] if v in closed else brute_tail(t, v)
            assert math.isclose(got[i], want, rel_tol=1e-8, abs_tol=1e-13), (t, v, got[i], want)


def test_slope_test_of_odd_tables(spark):
    def p(rows):
        return st.linregress_p_value(spark.createDataFrame(rows, "x double, y double"), "x", "y")

    assert p([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (4.0, 8.0)]) < 1e-6
    assert p([(1.0, 2.0), (2.0, 4.0)]) is None and p([]) is None and p([(1.0, 2.0), (1.0, 3.0), (1.0, 9.0)]) is None
    assert p([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)]) is None
    assert math.isclose(p([(-1.0, 1.0), (0.0, 0.0), (1.0, 1.0), (0.0, 5.0)]), 1.0)


def brute_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_with_ties_equals_pair_counting(spark):
    rows = [(int(i * 7 % 11 < 5), (i * 13 % 17) / 17) for i in range(200)]
    df = spark.createDataFrame(rows, "y int, p double").repartition(6)
    assert math.isclose(st.auc_by_rank(df, "y", "p").first().auc, brute_auc(rows))


def test_metrics_clip_and_round(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.5), (1, 1.0), (None, 0.3)], "y int, p double")
    m = st.metrics_binary(df, "y", "p").first()
    assert m.n == 3 and math.isclose(m.accuracy, 1 / 3) and math.isclose(m.log_loss, (-math.log(st.EPSILON) + math.log(2)) / 3, rel_tol=1e-9)
    assert math.isclose(st.metrics_binary(df, "y", "p", "round").first().accuracy, 2 / 3)


def test_report_uses_zero_for_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "y int, p int")
    got = {r["class"]: r for r in st.classification_report(df, "y", "p").collect()}
    assert got["1"].precision == 0 and got["1"].recall == 0 and got["1"].f1 == 0 and got["1"].support == 2
    assert math.isclose(got["accuracy"].f1, 1 / 3) and math.isclose(got["macro avg"].recall, 0.5)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    assert {r.y: r.weight for r in st.class_weights(df, "y").collect()} == {0: 4 / 6, 1: 2.0}
    assert st.class_ratio(df, "y").first().ratio == 3.0


def test_returns_and_lags(spark):
    df = spark.createDataFrame([(day(3), 10.0, 11.0), (day(1), 10.0, 9.0), (day(2), 0.0, 5.0), (day(4), None, 1.0)], "trade_date date, open_price double, close_price double")
    out = {r.trade_date.day: r for r in ft.lag_returns(px.add_returns(df), 2).collect()}
    assert (out[1].increase, out[3].increase, out[2].increase, out[4].daily_return) == (0, 1, None, None)
    assert math.isclose(out[3]["prev_return_t-2"], -0.1) and out[3]["prev_return_t-1"] is None
    again = {r.trade_date.day: r for r in ft.lag_returns_from_prices(df, 1).collect()}
    assert math.isclose(again[2]["prev_return_t-1"], -0.1) and again[1]["prev_return_t-1"] is None


def test_scaling_and_imputation_learn_from_train_rows_only(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 3.0), ("train", None), ("test", 100.0)], "split string, x double").withColumn("flat", F.lit(4.0))
    fill = ft.fit_imputation(df, ["x"], F.col("split") == "train")
    assert fill.means == {"x": 2.0}
    scaling = ft.fit_scaling(fill.transform(df), ["x", "flat"], F.col("split") == "train")
    assert scaling.stats["flat"] == (4.0, 1.0) and math.isclose(scaling.stats["x"][1], np.std([1, 3, 2]))


def test_source_column_selection():
    assert ft.select_source_columns(["s_a", "s_b_c"], "s", ["a", "zzz", "b-c"]) == ["s_a", "s_b_c"]
    with pytest.raises(ValueError):
        ft.select_source_columns(["x"], "s", ["a"])


def test_feature_frame_checks_columns_and_order(spark, sf_dir):
    market = fx.market(spark, sf_dir)
    with pytest.raises(ValueError):
        ft.feature_frame(market, ft.FeatureSpec(sentiment=("no_such",)))
    spec = ft.FeatureSpec(sentiment=("avg_sentiment",), n_lags=3, lags_from="prices", lag_nulls="impute", train=("1995-01-01", "1999-12-31"), test=("2000-01-01", "2001-12-31"))
    frame, names = ft.feature_frame(market, spec)
    assert len(names) == 1 + 3 + 3 + 3
    assert frame.where(" or ".join(f"`{n}` is null" for n in names)).count() == 0


def test_sources_come_from_scored_rows_of_each_label(spark):
    days = spark.createDataFrame([(day(d), 1.0) for d in (2, 3)], "trade_date date, x double")
    rows = [("2024-01-03 12:00:00", "a-b", 1.0, None), ("2024-01-03 12:00:00", "a.b", 3.0, None), ("2020-01-01 00:00:00", "far", 2.0, None), ("2024-01-03 12:00:00", "none", None, 5.0)]
    scored = spark.createDataFrame(rows, "at string, source string, s double, t double").withColumn("at", F.to_timestamp_ntz("at"))
    out = ag.aggregate_daily(days, scored, F.col("at"), {"s": "m", "t": "n"})
    assert set(out.columns) == {"trade_date", "x", "m", "m_a_b", "m_far", "n", "n_none"}
    third = out.where(F.col("trade_date") == F.lit(day(3))).first()
    assert (third.m, third.m_a_b, third.m_far, third.n_none) == (2.0, 2.0, None, 5.0)


def test_nan_scores_take_no_part(spark):
    rows = spark.createDataFrame([("g", 0.0, [1.0, 3.0]), ("g", float("nan"), [9.0, 9.0]), ("g", 0.0, [3.0, 1.0])], "g string, s double, v array<double>")
    assert ag.attention_pool(rows, "g", "s", "v").first().pooled == [2.0, 2.0]
    assert [r.weight for r in ag.softmax_weights(rows, "g", "s").collect()] == [0.5, 0.5]


def test_correlation_states_merge_to_the_whole_and_keep_small_differences(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    here = rng.random(x.shape) < 0.8
    states = [st._co_moments(np.where(h, p, 0), h) for p, h in zip(np.array_split(x, 7), np.array_split(here, 7))]
    state = states[0]
    for other in states[1:]:
        state = st._merge(state, other)
    assert np.allclose(state, st._co_moments(np.where(here, x, 0), here))
    rows = [[float(v) + 1e9 if h else None for v, h in zip(*r)] for r in zip(x, here)] + [[None, None, None], [float("nan"), 1e9, None]]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    got = {(r.col_a, r.col_b): r["corr"] for r in st.corr_matrix(df, ["a", "b", "c"]).collect()}
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            both = here[:, i] & here[:, j]
            # About seven digits are left of values near 1e9 with a spread of 1.
            assert got[a, b] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6)
    none = st.corr_matrix(df.where("false"), ["a", "b"]).collect()
    assert len(none) == 4 and all(r["corr"] is None for r in none)


def test_correlation_shuffles_one_row_per_task(spark):
    df = spark.range(0, 4000, 1, 6).selectExpr("cast(id as double) a", "cast(id % 7 as double) b")
    plan = st.corr_matrix(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.index("MapInArrow") > plan.index("FlatMapGroupsInArrow")


def test_softmax_of_hot_groups_extremes_and_types(spark):
    rows = [(1, i % 3 / 2.0, "x") for i in range(3000)] + [(2, 1000.0, "x"), (2, -1000.0, "x"), (3, float("-inf"), "x"), (3, float("-inf"), "x")]
    rows += [(4, None, "x"), (4, float("nan"), "x"), (None, 1.0, "x"), (5, float("inf"), "x"), (5, 0.0, "x")]
    df = spark.createDataFrame(rows, "g int, s double, _m string").repartition(7)
    got = {}
    for r in ag.softmax_weights(df, "g", "s").collect():
        got.setdefault(r.g, []).append((r.s, r.weight))
    assert set(got) == {1, 2, 3, 5} and all(sum(w for _, w in v) == pytest.approx(1) for v in got.values())
    z = 1000 * sum(np.exp(k / 2) for k in range(3))
    assert all(w == pytest.approx(np.exp(s) / z) for s, w in got[1])
    assert sorted(got[2]) == [(-1000.0, 0.0), (1000.0, 1.0)] and sorted(got[5]) == [(0.0, 0.0), (float("inf"), 1.0)]
    assert sorted(w for _, w in got[3]) == [0.5, 0.5]
    named = df.withColumn("g", F.concat(F.lit("k"), F.col("g").cast("string")))
    assert ag.softmax_weights(named, "g", "s").where("g = 'k2'").count() == 2
    assert ag.softmax_weights(df.where("false"), "g", "s").count() == 0

"""Correlation, simple regression, and binary classification metrics as aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bellwire.functions.numbers import numeric, ratio
from bellwire.operators.sequence import running_sums
from bellwire.session import broadcast_if_small

#: Fixed value: double precision epsilon, the bound log loss clips probabilities to.
EPSILON = 2.220446049250313e-16
#: Groups in which the states of tasks are merged before the last merge.
_MERGE_GROUPS = 64


def _co_moments(x: np.ndarray, here: np.ndarray) -> np.ndarray:
    """State of all column pairs over the rows where both are present: count, mean and square sum of the first, product sum.

    Entry (i, j) of each part is about column i in the rows that also have j. Values are centred on a row of the
    block before they are multiplied.
    """
    centre = np.where(here, x, 0).sum(axis=0) / np.maximum(here.sum(axis=0), 1)
    y, m = np.where(here, x - centre, 0.0), here.astype(float)
    n = m.T @ m
    sums = y.T @ m
    mean = np.divide(sums, n, out=np.zeros_like(sums), where=n > 0)
    return np.stack([n, centre[:, None] + mean, (y * y).T @ m - sums * mean, y.T @ y - sums * mean.T])


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of two sets of rows together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    mean = np.where(a[0] > 0, a[1] + gap * share, b[1])
    return np.stack([n, mean, a[2] + b[2] + gap * gap * a[0] * share, a[3] + b[3] + gap * gap.T * a[0] * share])


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations, long form (col_a, col_b, corr), in one pass.

    Each task sums one state of co-moments of all pairs, so what is shuffled is one row per task, not one per
    row or pair; states are merged in two rounds. Merging works on means and centred sums, which keeps small
    differences between large values. A constant column, or a pair without a common row, gives NULL.
    """
    width, names = len(columns), list(columns)
    values = df.select(*[numeric(c).alias(f"_x{i}") for i, c in enumerate(columns)])
    schema = "part int, state array<double>"

    def row(part: int, state: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([state.ravel()], pa.list_(pa.float64()))], names=["part", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                here = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
                x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
                state = _co_moments(x, here)
                total = state if total is None else _merge(total, state)
        if total is not None:
            yield row(TaskContext.get().partitionId() % _MERGE_GROUPS, total)

    def merged(group: pa.Table) -> np.ndarray:
        states = [np.array(s).reshape(4, width, width) for s in group.column("state").to_pylist()]
        return reduce(_merge, states)

    def halfway(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([row(0, merged(group))])

    def finish(group: pa.Table) -> pa.Table:
        n, _, square, product = merged(group)
        spread = np.sqrt(square) * np.sqrt(square.T)
        cells = [(a, b, float(product[i, j] / spread[i, j]) if spread[i, j] > 0 else None) for i, a in enumerate(names) for j, b in enumerate(names)]
        columns = zip(zip(*cells), (pa.string(), pa.string(), pa.float64()))
        return pa.table([pa.array(c, t) for c, t in columns], names=["col_a", "col_b", "corr"])

    states = values.mapInArrow(run, schema).groupBy("part").applyInArrow(halfway, schema)
    found = states.groupBy("part").applyInArrow(finish, "col_a string, col_b string, corr double")
    # A table without rows has no states, but its pairs are answered all the same.
    pairs = df.sparkSession.createDataFrame([(a, b) for a in names for b in names], "col_a string, col_b string")
    return pairs.join(F.broadcast(found), ["col_a", "col_b"], "left")


def linregress(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, r, r squared and slope standard error of y on x, over complete rows."""
    rows = df.select(numeric(x).alias("_x"), numeric(y).alias("_y")).na.drop()
    m = rows.agg(
        F.count("*").alias("n"),
        F.avg("_x").alias("mx"),
        F.avg("_y").alias("my"),
        F.var_pop("_x").alias("vx"),
        F.var_pop("_y").alias("vy"),
        F.covar_pop("_x", "_y").alias("cxy"),
    )
    slope = ratio(F.col("cxy"), F.col("vx"))
    r2 = ratio(F.col("cxy") * F.col("cxy"), F.col("vx") * F.col("vy"))
    return m.select(
        "n",
        slope.alias("slope"),
        (F.col("my") - slope * F.col("mx")).alias("intercept"),
        ratio(F.col("cxy"), F.sqrt(F.col("vx") * F.col("vy"))).alias("r_value"),
        r2.alias("r_squared"),
        F.sqrt(ratio(ratio((F.lit(1.0) - r2) * F.col("vy"), F.col("vx")), F.col("n") - 2)).alias("stderr"),
    )


def _half_gamma_ratio(a: Column, shift: int = 16) -> Column:
    """Gamma(a + 1/2) / Gamma(a): the recurrence moves the argument up, where a short asymptotic series is exact."""
    z = a + shift
    series = 1 - 1 / (8 * z) + 1 / (128 * z**2) + 5 / (1024 * z**3) - 21 / (32768 * z**4) - 399 / (262144 * z**5)
    steps = reduce(mul, [(a + k) / (a + k + 0.5) for k in range(shift)])
    return F.sqrt(z) * series * steps


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function, in the modified Lentz form.

    It settles within about the square root of the larger parameter; every step is one turn of a higher-order function.
    """
    tiny = F.lit(1e-300)

    def safe(value: Column) -> Column:
        return F.when(F.abs(value) < tiny, tiny).otherwise(value)

    def turn(state: Column, term: Column) -> Column:
        d = 1 / safe(1 + term * state["d"])
        c = safe(1 + term / state["c"])
        return F.struct(d.alias("d"), c.alias("c"), (state["h"] * d * c).alias("h"))

    def step(state: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return turn(turn(state, even), odd)

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
    turns = (60 + 6 * F.sqrt(F.greatest(a, b))).cast("int")
    return F.aggregate(F.sequence(F.lit(1), turns), start, step)["h"]


def t_two_sided(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|) of Student's t with ``freedom`` degrees, as a column expression.

    It is the regularised incomplete beta function I_x(freedom / 2, 1 / 2) at x = freedom / (freedom + t^2); the
    side on which the continued fraction converges fast is taken. Without freedom, or for a NULL, it is NULL;
    for an infinite t it is 0.
    """
    n, squared = freedom.cast("double"), t * t
    a, x, y = n / 2, n / (n + squared), squared / (n + squared)
    # x^a (1 - x)^(1/2) / B(a, 1/2), the power taken through log1p so that it holds for t near 0 and many degrees.
    front = F.exp(-a * F.log1p(squared / n)) * F.sqrt(y) * _half_gamma_ratio(a) / math.sqrt(math.pi)
    half = F.lit(0.5)
    tail = F.when(x < (a + 1) / (a + 2.5), front / a * _beta_fraction(x, a, half))
    tail = tail.otherwise(1 - front / half * _beta_fraction(y, half, a))
    return F.when(n > 0, F.when(F.abs(t) == float("inf"), 0.0).when(t == 0, 1.0).otherwise(tail))


def linregress_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """The row of ``linregress`` with the two-sided p-value of a zero slope; a perfect fit has 0.

    With fewer than three rows, or a constant x or y, there is no test and the p-value is NULL.
    """
    fit = linregress(df, x, y)
    t = F.when(F.col("stderr") > 0, F.col("slope") / F.col("stderr")).when(F.col("slope") != 0, float("inf"))
    return fit.withColumn("p_value", F.when(F.col("r_value").isNotNull(), t_two_sided(t, F.col("n") - 2)))


def linregress_p_value(df: DataFrame, x: str, y: str) -> float | None:
    """Two-sided p-value of the slope."""
    return linregress_test(df, x, y).first()["p_value"]


def regression_points(df: DataFrame, x: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    """The scatter points with the fitted value of the regression line."""
    fit = linregress(df, x, y)
    slope, intercept = fit.select("slope").scalar(), fit.select("intercept").scalar()
    points = df.select(*keep, numeric(x).alias("x"), numeric(y).alias("y")).na.drop(subset=["x", "y"])
    return points.withColumn("fitted", slope * F.col("x") + intercept)


def score_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and count of non-null scores per column, one row."""
    aggs = [
        a for c in columns for a in (F.avg(numeric(c)).alias(f"avg_{c}"), F.count(numeric(c)).alias(f"n_{c}"))
    ]
    return df.agg(*aggs)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes * n_class) of every label present."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n_class"))
    n = counts.select(F.sum("n_class")).scalar()
    classes = counts.select(F.count("*")).scalar()
    return counts.withColumn("weight", n / (classes * F.col("n_class")))


def with_class_weights(df: DataFrame, label: str, out: str = "class_weight") -> DataFrame:
    """Rows with the weight of their label; the weight table is broadcast only if it is counted small."""
    weights = class_weights(df, label).select(F.col(label).alias("_label"), F.col("weight").alias(out))
    return df.join(broadcast_if_small(weights), F.col(label) == F.col("_label"), "left").drop("_label")


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive, the weight of the positive class in boosting."""
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(neg.alias("n_neg"), pos.alias("n_pos"), ratio(neg, pos).alias("ratio"))


def auc_by_rank(df: DataFrame, label: str, proba: str, num_partitions: int | None = None) -> DataFrame:
    """Exact ROC AUC with ties counted half.

    Rows collapse to counts per distinct score; negatives below each score come from running sums
    over range-partitioned scores, so nothing is sorted in one task.
    """
    groups = (
        df.where(F.col(label).isNotNull() & F.col(proba).isNotNull())
        .groupBy(proba)
        .agg(
            F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
        )
    )
    placed = running_sums(groups, [proba], {"neg_below": "neg"}, num_partitions)
    pos, neg = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return placed.agg(
        pos.alias("n_pos"), neg.alias("n_neg"), ratio(wins, pos.cast("double") * neg).alias("auc")
    )


def auc_per_group(df: DataFrame, group: str, label: str, proba: str) -> DataFrame:
    """Exact ROC AUC of each group, ties half, over counts per distinct score."""
    rows = df.where(F.col(label).isNotNull() & F.col(proba).isNotNull())
    counts = rows.groupBy(group, proba).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    below = W.partitionBy(group).orderBy(proba).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("neg_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    pos, neg = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return placed.groupBy(group).agg(ratio(wins, pos.cast("double") * neg).alias("auc"))


def predicted_label(proba: Column, rule: str = "threshold") -> Column:
    """1 when the probability is at least 0.5; ``rule="round"`` rounds half to even, so 0.5 is 0."""
    return F.when(proba > 0.5 if rule == "round" else proba >= 0.5, 1).otherwise(0)


def metrics_binary(df: DataFrame, label: str, proba: str, rule: str = "threshold") -> DataFrame:
    """Row count, accuracy and log loss in one pass."""
    rows = df.where(F.col(label).isNotNull() & F.col(proba).isNotNull())
    p = F.greatest(F.lit(EPSILON), F.least(F.lit(1.0 - EPSILON), F.col(proba)))
    loss = -F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p))
    hit = F.when(predicted_label(F.col(proba), rule) == F.col(label), 1.0).otherwise(0.0)
    return rows.agg(
        F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(loss).alias("log_loss")
    )


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted averages.

    A zero denominator gives 0. The confusion counts are one aggregate; the rest is one row of
    arithmetic.
    """
    zero = F.lit(0.0)
    classes = [0, 1]
    cells = [
        F.count_if((F.col(label) == t) & (F.col(predicted) == p)).alias(f"c{t}{p}")
        for t, p in product(classes, classes)
    ]
    counts = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).agg(*cells)
    line = {}
    for k in classes:
        o = 1 - k
        support = F.col(f"c{k}{k}") + F.col(f"c{k}{o}")
        precision = F.coalesce(ratio(F.col(f"c{k}{k}"), F.col(f"c{k}{k}") + F.col(f"c{o}{k}")), zero)
        recall = F.coalesce(ratio(F.col(f"c{k}{k}"), support), zero)
        f1 = F.coalesce(ratio(2 * precision * recall, precision + recall), zero)
        line[k] = (precision, recall, f1, support)
    total = line[0][3] + line[1][3]
    accuracy = ratio(F.col("c00") + F.col("c11"), total)
    macro = [(line[0][i] + line[1][i]) / 2 for i in range(3)]
    weighted = [ratio(line[0][i] * line[0][3] + line[1][i] * line[1][3], total) for i in range(3)]

    def row(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    rows = [row(str(k), *line[k]) for k in classes]
    rows.append(row("accuracy", accuracy, accuracy, accuracy, total))
    rows.append(row("macro avg", *macro, total))
    rows.append(row("weighted avg", *weighted, total))
    return counts.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")

"""Classifiers over the daily table on ``pyspark.ml``: search, fit, evaluate, save.

The daily table has one row per trading day, so it is prepared once, cached, and many small fits
run on it side by side. Logistic searches and refits share their passes (``logistic``), forest searches
their grown trees (``forests``), network refits one job (``networks``).
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from itertools import product

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwire.operators.features import FeatureSpec, Scaling, fit_feature_frame, fit_scaling
from bellwire.operators.sequence import number_rows, time_series_folds
from bellwire.operators.stats import auc_by_rank, auc_per_group, metrics_binary, predicted_label
from bellwire.plans import forests
from bellwire.plans.artefacts import whole_pipeline
from bellwire.plans.logistic import Problem, fit_many, positioned, scores
from bellwire.plans.networks import Network, refit_scores
from bellwire.plans.parallel import run_side_by_side
from bellwire.session import materialise, work_path

SEED = 42
LABEL, WEIGHT = "increase", "class_weight"
#: Spark's deepest tree; stands for "no limit".
MAX_DEPTH = 30
#: Rows of a model frame per task of a fit.
ROWS_PER_PARTITION = 50_000

# The parameter grids searched for each family and variant.
LOGISTIC_GRID = {"C": [0.001, 0.01, 0.1, 1.0], "l1_ratio": [0.0, 0.25, 0.5, 0.75, 1.0]}
FOREST_GRID_BASELINE = {
    "n_estimators": [100, 200],
    "max_depth": [3, 5, 10],
    "min_samples_split": [5, 10, 20],
    "max_features": ["sqrt", "log2"],
}
FOREST_GRID = {
    "n_estimators": [100, 200],
    "max_depth": [3, 5, 10, None],
    "min_samples_split": [2, 5, 10],
    "max_features": ["sqrt", "log2"],
}


def expand_grid(grid: dict[str, list]) -> list[dict]:
    """All settings, the last parameter varying fastest in name order."""
    names = sorted(grid)
    return [dict(zip(names, values)) for values in product(*(grid[n] for n in names))]


# -- estimators ---------------------------------------------------------------------------------
def logistic(params: dict, weight_sum: float) -> Estimator:
    """Elastic-net logistic regression.

    C * sum(w * loss) + penalty, divided by C * sum(w), is Spark's objective with
    regParam = 1 / (C * sum(w)).
    """
    return LogisticRegression(
        labelCol=LABEL,
        weightCol=WEIGHT,
        regParam=1.0 / (params["C"] * weight_sum),
        elasticNetParam=params["l1_ratio"],
        standardization=False,
        maxIter=1000,
    )


def forest(params: dict, weight_sum: float) -> Estimator:
    """Random forest; a minimum split size s becomes at least s // 2 rows per child."""
    return RandomForestClassifier(
        labelCol=LABEL,
        weightCol=WEIGHT,
        numTrees=params.get("n_estimators", 100),
        maxDepth=params.get("max_depth") or MAX_DEPTH,
        minInstancesPerNode=max(1, params.get("min_samples_split", 2) // 2),
        featureSubsetStrategy=params.get("max_features", "sqrt"),
        seed=SEED,
    )


def boosted(params: dict, weight_sum: float) -> Estimator:
    """Boosted trees: 100 rounds, depth 5, rate 0.05, 80 % of rows and of columns per split."""
    return GBTClassifier(
        labelCol=LABEL,
        weightCol=WEIGHT,
        maxIter=params.get("n_estimators", 100),
        maxDepth=params.get("max_depth", 5),
        stepSize=params.get("learning_rate", 0.05),
        subsamplingRate=params.get("subsample", 0.8),
        featureSubsetStrategy=str(params.get("colsample", 0.8)),
        seed=SEED,
    )


@dataclass(frozen=True)
class Family:
    """How one model family is built: estimator, class weighting, scaling, feature preparation."""

    name: str
    build: Callable[[dict, float], Estimator]
    weighting: str  # "balanced": n / (2 n_class); "positive": positives weigh n_neg / n_pos
    scale: bool
    grids: dict[str, dict[str, list]]
    spec: dict[str, dict]


FAMILIES = {
    "lr": Family(
        "lr",
        logistic,
        "balanced",
        True,
        {v: LOGISTIC_GRID for v in ("baseline", "consolidated", "sources")},
        {v: {"lags_from": "returns", "n_lags": 5} for v in ("baseline", "consolidated", "sources")},
    ),
    "rf": Family(
        "rf",
        forest,
        "balanced",
        False,
        {"baseline": FOREST_GRID_BASELINE, "consolidated": FOREST_GRID, "sources": FOREST_GRID},
        {
            "baseline": {"lags_from": "returns", "with_interactions": False},
            "consolidated": {"lags_from": "prices", "with_interactions": False, "lag_nulls": "impute"},
            "sources": {"lags_from": "prices", "with_interactions": False, "lag_nulls": "impute"},
        },
    ),
    "gbt": Family(
        "gbt",
        boosted,
        "positive",
        False,
        {v: {} for v in ("baseline", "consolidated", "sources")},
        {
            "baseline": {"lags_from": "prices", "with_interactions": False},
            "consolidated": {"lags_from": "prices", "with_interactions": False, "lag_nulls": "impute"},
            "sources": {"lags_from": "prices", "with_interactions": False, "lag_nulls": "impute"},
        },
    ),
}


# -- fitting ------------------------------------------------------------------------------------
def class_weight_values(n0: int, n1: int, weighting: str) -> tuple[float, float]:
    """Weights of a negative and a positive row, from the class counts."""
    if weighting == "balanced":
        return (n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)
    return 1.0, n0 / n1


def weigh(df: DataFrame, weighting: str) -> tuple[DataFrame, float]:
    """Rows with class weights learnt from them, and the weight sum. Both classes must occur."""
    n0, n1 = df.agg(F.count_if(F.col(LABEL) == 0), F.count_if(F.col(LABEL) == 1)).first()
    if n0 == 0 or n1 == 0:
        raise ValueError("training rows hold one class only")
    w0, w1 = class_weight_values(n0, n1, weighting)
    weight = F.when(F.col(LABEL) == 1, F.lit(w1)).otherwise(F.lit(w0))
    return df.withColumn(WEIGHT, weight), w0 * n0 + w1 * n1


def sized(df: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Cached rows in as few partitions as their number calls for.

    An iterative fit runs one job per step, so a short daily series spread over many tiny tasks
    spends its time on scheduling. The partition count grows with the rows.
    """
    n = df.count()
    parts = max(1, math.ceil(n / rows_per_partition))
    return df.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)


def _auc(model: Model, rows: DataFrame) -> float:
    """Area under the curve over all thresholds."""
    scorer = BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="rawPrediction", numBins=0)
    return scorer.evaluate(model.transform(rows))


@dataclass(frozen=True)
class _Fold:
    train: DataFrame
    test: DataFrame
    weight_sum: float
    usable: bool


def _fold_parts(train: DataFrame, folds: int, weighting: str) -> tuple[DataFrame, list[_Fold]]:
    """The cached fold rows with class weights, and each fold's parts.

    One aggregate counts the classes of all folds, so the fits need no counts of their own.
    """
    placed = time_series_folds(train, "trade_date", folds, num_partitions=train.rdd.getNumPartitions())
    counts = {
        (r["fold"], r["role"]): (r["n0"], r["n1"])
        for r in placed.groupBy("fold", "role")
        .agg(F.count_if(F.col(LABEL) == 0).alias("n0"), F.count_if(F.col(LABEL) == 1).alias("n1"))
        .collect()
    }
    weight, sums, usable = F.lit(1.0), {}, {}
    for k in range(1, folds + 1):
        n0, n1 = counts.get((k, "train"), (0, 0))
        usable[k] = n0 > 0 and n1 > 0 and all(n > 0 for n in counts.get((k, "test"), (0, 0)))
        w0, w1 = class_weight_values(n0, n1, weighting) if usable[k] else (1.0, 1.0)
        sums[k] = w0 * n0 + w1 * n1
        mine = F.when(F.col(LABEL) == 1, F.lit(w1)).otherwise(F.lit(w0))
        weight = F.when(F.col("fold") == k, mine).otherwise(weight)
    rows = sized(placed.drop("row_no").withColumn(WEIGHT, weight))

    def part(k: int, role: str) -> DataFrame:
        return rows.where((F.col("fold") == k) & (F.col("role") == role))

    return rows, [_Fold(part(k, "train"), part(k, "test"), sums[k], usable[k]) for k in range(1, folds + 1)]


def ts_grid_search(
    train: DataFrame,
    build: Callable[[dict, float], Estimator],
    settings: Sequence[dict],
    folds: int = 5,
    weighting: str = "balanced",
    parallelism: int = 8,
) -> tuple[dict, DataFrame]:
    """Best setting by mean ROC AUC over time-ordered folds, and the score table.

    Each fold trains only on rows before its test rows. The first setting wins ties. A fold whose
    train or test rows hold one class has no AUC, and then no setting can be told from another.
    """
    spark = train.sparkSession
    rows, parts = _fold_parts(train, folds, weighting)

    def job(setting: dict, fold: _Fold) -> float:
        if not fold.usable:
            return math.nan
        return _auc(build(setting, fold.weight_sum).fit(fold.train), fold.test)

    pairs = [(i, k) for i in range(len(settings)) for k in range(folds)]
    try:
        tasks = [lambda p=p: job(settings[p[0]], parts[p[1]]) for p in pairs]
        found = run_side_by_side(spark, tasks, parallelism)
    finally:
        rows.unpersist()
    table = [(i, str(settings[i]), k + 1, float(s)) for (i, k), s in zip(pairs, found)]
    return _best(settings, table, folds, spark)


def _best(settings: Sequence[dict], table: list[tuple], folds: int, spark: SparkSession) -> tuple[dict, DataFrame]:
    means = [sum(r[3] for r in table if r[0] == i) / folds for i in range(len(settings))]
    best = max(range(len(settings)), key=lambda i: (-math.inf if math.isnan(means[i]) else means[i], -i))
    return settings[best], spark.createDataFrame(table, "setting int, params string, fold int, auc double")


def logistic_search(train: DataFrame, width: int, settings: Sequence[dict], folds: int = 5, weighting: str = "balanced") -> tuple[dict, DataFrame]:
    """``ts_grid_search`` for elastic-net logistic models, all settings and folds in shared passes."""
    spark = train.sparkSession
    # As many ranges as the rows call for: those of the session would be mostly empty tasks and files.
    numbered = sized(number_rows(train, ["trade_date"], out="_row", num_partitions=train.rdd.getNumPartitions()))
    n = numbered.count()
    rows = positioned(numbered, F.col("_row") - 1, LABEL)
    bounds = forests.fold_bounds(n, folds)
    edges = sorted({e for b in bounds for e in b})
    part = sum((F.when(F.col("at") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    found = {r[0]: r for r in rows.groupBy(part.alias("p")).agg(F.sum("y").alias("n1"), F.count("*").alias("n")).collect()}

    def classes(low: int, high: int) -> tuple[int, int]:
        inside = [r for p, r in found.items() if (edges[p - 1] if p else 0) >= low and (edges[p] if p < len(edges) else n) <= high]
        n1 = int(sum(r.n1 for r in inside))
        return sum(r.n for r in inside) - n1, n1

    cells, problems = [], []
    for k, (first, end) in enumerate(bounds):
        n0, n1 = classes(0, first)
        if min(n0, n1, *classes(first, end)) == 0:
            continue
        weights = class_weight_values(n0, n1, weighting)
        for i, s in enumerate(settings):
            cells.append((i, k))
            problems.append(Problem(first, *weights, s["C"], s["l1_ratio"]))
    aucs = {}
    if problems:
        coefficients = fit_many(rows, width, problems)
        scored = scores(rows, width, coefficients, [bounds[k] for _, k in cells])
        aucs = {cells[r.problem]: r.auc for r in auc_per_group(scored, "problem", "y", "proba").collect()}
    numbered.unpersist()
    return _best(settings, [(i, str(s), k + 1, float(aucs.get((i, k), math.nan))) for i, s in enumerate(settings) for k in range(folds)], folds, spark)


@dataclass
class Fitted:
    """A trained model with what is needed to apply and explain it."""

    pipeline: PipelineModel
    features: list[str]
    params: dict
    scaling: Scaling | None
    frame: DataFrame
    search: DataFrame | None = None
    cached: DataFrame | None = None
    spec: FeatureSpec | None = None
    means: dict[str, float | None] = field(default_factory=dict)

    @property
    def model(self) -> Model:
        return self.pipeline.stages[-1]

    def predict(self, rows: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """trade_date, actual_increase, predicted_proba, predicted_label for the test rows."""
        rows = self.frame.where("split = 'test'") if rows is None else rows
        scored = self.pipeline.transform(rows)
        proba = vector_to_array(F.col("probability"))[1]
        return scored.select(
            "trade_date",
            *[F.col(f"`{k}`") for k in keep],
            F.col(LABEL).alias("actual_increase"),
            proba.alias("predicted_proba"),
            predicted_label(proba).alias("predicted_label"),
        )

    def weights(self) -> DataFrame:
        """Coefficients with the intercept, or feature importances, by feature name."""
        spark = self.frame.sparkSession
        if hasattr(self.model, "coefficients"):
            rows = [(n, float(w)) for n, w in zip(self.features, self.model.coefficients)]
            rows.append(("intercept", float(self.model.intercept)))
            return spark.createDataFrame(rows, "feature string, coefficient double")
        rows = [(n, float(w)) for n, w in zip(self.features, self.model.featureImportances.toArray())]
        return spark.createDataFrame(rows, "feature string, importance double")

    def top_importances(self, n: int = 10) -> DataFrame:
        table = self.weights()
        return table.orderBy(F.desc(table.columns[1]), "feature").limit(n)

    def metrics(self) -> DataFrame:
        """One row: n, accuracy, log loss, AUC over the test rows."""
        preds = self.predict().persist(StorageLevel.MEMORY_AND_DISK)
        basic = metrics_binary(preds, "actual_increase", "predicted_proba")
        auc = auc_by_rank(preds, "actual_increase", "predicted_proba", preds.rdd.getNumPartitions()).select("auc").scalar()
        return basic.withColumn("auc", auc)

    def release(self) -> None:
        """Drop the cached frame once results are out."""
        if self.cached is not None:
            self.cached.unpersist()

    def save(self, path: str) -> str:
        self.pipeline.write().overwrite().save(path)
        return path

    def save_whole(self, path: str) -> str:
        """The artefact with lags, imputation means and interactions before the scaling: it takes raw daily rows."""
        if self.spec is None:
            raise ValueError("the model was fitted on ready features")
        whole_pipeline(self.spec, self.means, self.pipeline).write().overwrite().save(path)
        return path

    def save_predictions(self, path: str) -> str:
        """Predictions as CSV with a header, in date order."""
        self.predict().orderBy("trade_date").write.option("header", True).csv(path)
        return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def artefact_path(spark, family: str, variant: str, name: str, kind: str) -> str:
    """Family, variant and model name all appear, so variants never overwrite one another."""
    return work_path(spark, f"{kind}-{family}-{variant}-{name}")


def _assembled(df: DataFrame, names: Sequence[str]) -> tuple[VectorAssembler, DataFrame]:
    """Feature names carry dots, dashes and stars, so positions name the vector's inputs."""
    plain = [f"f{i}" for i in range(len(names))]
    renamed = df.withColumns({p: F.col(f"`{n}`").cast("double") for p, n in zip(plain, names)})
    return VectorAssembler(inputCols=plain, outputCol="features"), renamed


def _inputs(names: Sequence[str], scaling: Scaling | None) -> list[Transformer]:
    """Stages from named feature columns to the vector: scaling as literals, then assembly.

    They are saved with the model, so a loaded pipeline takes unscaled feature rows.
    """
    plain = [f"f{i}" for i in range(len(names))]
    parts = []
    for short, name in zip(plain, names):
        value = "cast(`" + name.replace("`", "``") + "` as double)"
        if scaling is not None:
            mean, spread = scaling.stats[name]
            value = f"({value} - ({float(mean)!r}D)) / {float(spread)!r}D"
        parts.append(f"{value} AS {short}")
    statement = f"SELECT *, {', '.join(parts)} FROM __THIS__"
    return [SQLTransformer(statement=statement), VectorAssembler(inputCols=plain, outputCol="features")]


def fit_family(
    daily: DataFrame,
    family: str,
    variant: str,
    sentiment: Sequence[str] = (),
    grid: dict[str, list] | None = None,
    folds: int = 5,
    parallelism: int = 8,
    **spec,
) -> Fitted:
    """Prepare features, search the grid over time-ordered folds, refit the best on all train rows."""
    fam = FAMILIES[family]
    options = {**fam.spec[variant], **spec, "sentiment": tuple(sentiment)}
    chosen = FeatureSpec(**options)
    frame, names, imputation = fit_feature_frame(daily, chosen)
    frame = sized(materialise(frame, "features"))
    scaling = fit_scaling(frame, names, F.col("split") == "train") if fam.scale else None
    inputs = _inputs(names, scaling)
    train = PipelineModel(inputs).transform(frame.where("split = 'train'")).select("trade_date", LABEL, "features")
    train = sized(train)
    settings = expand_grid(fam.grids[variant] if grid is None else grid)
    search = None
    params = settings[0] if settings else {}
    nested = fam.name == "rf" and forests.fits_in_tasks(train, len(names))
    rows = forests.collect_rows(train, LABEL) if nested else None
    if len(settings) > 1:
        if nested:
            params, search = forests.nested_search(daily.sparkSession, rows, settings, folds, SEED)
        elif fam.name == "lr":
            params, search = logistic_search(train, len(names), settings, folds, fam.weighting)
        else:
            params, search = ts_grid_search(train, fam.build, settings, folds, fam.weighting, parallelism)
    fit_rows, weight_sum = weigh(train, fam.weighting)
    estimator = fam.build(params, weight_sum)
    model = forests.fit_forest(daily.sparkSession, rows, params, SEED, estimator, fit_rows) if nested else estimator.fit(fit_rows)
    train.unpersist()
    return Fitted(PipelineModel([*inputs, model]), list(names), params, scaling, frame, search, frame, chosen, imputation.means)


# -- walk-forward and day-vector models -----------------------------------------------------------
def fit_rows_model(train: DataFrame, names: Sequence[str], estimator: Callable[[float], Estimator], weighting="balanced"):
    assembler, ready = _assembled(train, names)
    weighted, weight_sum = weigh(ready, weighting)
    return Pipeline(stages=[assembler, estimator(weight_sum)]).fit(weighted)


def walk_forward(
    frame: DataFrame,
    names: Sequence[str],
    estimator: Callable[[float], Estimator],
    train_start: str | date,
    test_start: str | date,
    test_end: str | date,
    refit_every: int = 1,
    min_train: int = 10,
    parallelism: int = 4,
) -> DataFrame:
    """Predict each test day from a model trained on all earlier days from ``train_start`` on.

    A fresh model is fitted every ``refit_every`` test days and serves the days up to the next
    refit. Days with fewer than ``min_train`` earlier rows, or with one class only before them, get
    no prediction. Only the refit dates come to the driver.
    """
    frame = sized(frame)
    day = F.col("trade_date")
    start, lo, hi = (F.lit(d).cast("date") for d in (train_start, test_start, test_end))
    test_days = [r[0] for r in frame.where(day.between(lo, hi)).select(day).distinct().orderBy(day).collect()]
    blocks = [test_days[i : i + refit_every] for i in range(0, len(test_days), refit_every)]
    usable = frame.where(day >= start)

    sink = work_path(frame.sparkSession, "walk-forward")

    def job(number: int, block: list[date]) -> bool:
        past = usable.where(day < F.lit(block[0]))
        n, lo_label, hi_label = past.agg(F.count("*"), F.min(LABEL), F.max(LABEL)).first()
        if n < min_train or lo_label == hi_label:
            return False
        model = fit_rows_model(past, names, estimator)
        rows = _assembled(frame.where(day.between(F.lit(block[0]), F.lit(block[-1]))), names)[1]
        proba = vector_to_array(F.col("probability"))[1]
        model.transform(rows).select(
            "trade_date", F.col(LABEL).alias("actual_increase"), proba.alias("predicted_proba")
        ).write.parquet(f"{sink}/block={number}")
        return True

    tasks = [lambda i=i, b=b: job(i, b) for i, b in enumerate(blocks)]
    # Blocks meet in stored files: a union of hundreds of model plans would be costly to plan.
    if not any(run_side_by_side(frame.sparkSession, tasks, parallelism)):
        raise ValueError("no test day has enough earlier rows")
    label_type = frame.schema[LABEL].dataType.simpleString()
    schema = f"trade_date date, actual_increase {label_type}, predicted_proba double, block int"
    out = frame.sparkSession.read.schema(schema).parquet(sink).drop("block")
    return out.withColumn("predicted_label", predicted_label(F.col("predicted_proba"), "round"))


def _refits(frame: DataFrame, train_start, test_start, test_end, refit_every: int, min_train: int) -> list[tuple]:
    """(first scored day, day behind the last, class weights before it) of every refit with enough rows of both classes.

    What comes to the driver is one row per trading day.
    """
    ordinal = F.datediff(F.col("trade_date"), F.lit("1970-01-01").cast("date"))
    per_day = frame.groupBy(ordinal.alias("day")).agg(F.count(LABEL).alias("n"), F.sum(LABEL).cast("long").alias("n1")).orderBy("day").collect()
    start, low, high = ((date.fromisoformat(str(d)) - date(1970, 1, 1)).days for d in (train_start, test_start, test_end))
    days = [r.day for r in per_day if low <= r.day <= high]
    blocks = [days[i : i + refit_every] for i in range(0, len(days), refit_every)]
    out, n, n1, at = [], 0, 0, 0
    for block in blocks:
        while per_day[at].day < block[0]:
            if per_day[at].day >= start:
                n, n1 = n + per_day[at].n, n1 + (per_day[at].n1 or 0)
            at += 1
        if n >= min_train and 0 < n1 < n:
            out.append((block[0], block[-1] + 1, class_weight_values(n - n1, n1, "balanced")))
    if not out:
        raise ValueError("no test day has enough earlier rows")
    return out


def walk_forward_logistic(
    frame: DataFrame,
    names: Sequence[str],
    train_start: str | date,
    test_start: str | date,
    test_end: str | date,
    c: float = 1.0,
    l1_ratio: float = 0.0,
    refit_every: int = 1,
    min_train: int = 10,
) -> DataFrame:
    """``walk_forward`` with elastic-net logistic models, the refits of all days in shared passes."""
    frame = sized(frame)
    ordinal = F.datediff(F.col("trade_date"), F.lit("1970-01-01").cast("date"))
    refits = _refits(frame, train_start, test_start, test_end, refit_every, min_train)
    usable = positioned(frame.where(F.col("trade_date") >= F.lit(train_start).cast("date")), ordinal, LABEL, names)
    coefficients = fit_many(usable, len(names), [Problem(first, *weights, c, l1_ratio) for first, _, weights in refits])
    scored = scores(positioned(frame, ordinal, LABEL, names), len(names), coefficients, [(first, end) for first, end, _ in refits])
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("at").cast("int"))
    return scored.select(
        day.alias("trade_date"),
        F.col("y").cast(frame.schema[LABEL].dataType).alias("actual_increase"),
        F.col("proba").alias("predicted_proba"),
        predicted_label(F.col("proba"), "round").alias("predicted_label"),
    )


def walk_forward_network(
    frame: DataFrame,
    names: Sequence[str],
    train_start: str | date,
    test_start: str | date,
    test_end: str | date,
    network: Network = Network(),
    refit_every: int = 1,
    min_train: int = 10,
) -> DataFrame:
    """``walk_forward`` with a network trained afresh at every refit, all refits in one job.

    A frame too large to go to every task is refused; ``walk_forward`` with ``perceptron`` takes those.
    """
    spark = frame.sparkSession
    assembler, ready = _assembled(frame, names)
    ready = sized(assembler.transform(ready).select("trade_date", LABEL, "features"))
    if not forests.fits_in_tasks(ready, len(names)):
        raise ValueError("too many rows to send to every task: use walk_forward with perceptron")
    rows = forests.collect_rows(ready, LABEL)
    days = sorted((r[0] - date(1970, 1, 1)).days for r in ready.select("trade_date").collect())
    start = bisect_left(days, (date.fromisoformat(str(train_start)) - date(1970, 1, 1)).days)
    refits = [
        (start, bisect_left(days, first), bisect_left(days, first), bisect_left(days, end))
        for first, end, _ in _refits(ready, train_start, test_start, test_end, refit_every, min_train)
    ]
    scored = refit_scores(spark, rows, refits, network)
    # Rows of one day share its place; the frame has one row per day.
    dated = spark.createDataFrame([(i, date(1970, 1, 1) + timedelta(d), int(y)) for i, (d, y) in enumerate(zip(days, rows.y))], "row long, trade_date date, actual_increase int")
    return scored.join(F.broadcast(dated), "row").select(
        "trade_date",
        F.col("actual_increase").cast(frame.schema[LABEL].dataType).alias("actual_increase"),
        F.col("proba").alias("predicted_proba"),
        predicted_label(F.col("proba"), "round").alias("predicted_label"),
    )


def perceptron(n_inputs: int, hidden: int = 64, max_iter: int = 100) -> Callable[[float], Estimator]:
    """Two-layer network classifier; it has no weight column."""

    def build(weight_sum: float) -> Estimator:
        return MultilayerPerceptronClassifier(
            labelCol=LABEL, layers=[n_inputs, hidden, 2], maxIter=max_iter, seed=SEED
        )

    return build

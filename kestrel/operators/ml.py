"""Training, scoring and model search with Spark ML.

The learners are MLlib's distributed estimators; class balance enters as a weight
column. Boosted-tree presets map both boosted families of the reference onto
``GBTClassifier`` (leaf-wise growth and per-tree column sampling have no MLlib equal).
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.metrics import binary_metrics, ranking_metrics

# --- Fixed values: baseline learner presets, equal the reference's training configuration -------
FIXED_PRESETS = {
    "logistic_regression": {"C": 1.0, "max_iter": 500},
    "random_forest": {"n_estimators": 80, "max_depth": 18, "min_samples_leaf": 2, "max_features": "sqrt"},
    "xgboost": {"n_estimators": 200, "max_depth": 6, "learning_rate": 0.1, "subsample": 0.8},
    "hist_gradient_boosting": {"max_iter": 200, "learning_rate": 0.1, "max_leaf_nodes": 31, "max_depth": None,
                               "min_samples_leaf": 20},
}
# -------------------------------------------------------------------------------------------------
#: The deepest tree MLlib grows; "no limit" means this.
DEEPEST = 30


def with_class_weights(df: DataFrame, target: str = "target", weight: str = "class_weight") -> DataFrame:
    """Balanced weights n / (2 * n_class), joined from a two-row aggregate."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n_c"))
    total = counts.agg(F.sum("_n_c").alias("_n"))
    w = counts.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").select(
        target, (F.col("_n") / (2.0 * F.col("_n_c"))).alias(weight))
    return df.join(F.broadcast(w), target)  # two rows: bounded by the class count


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features_vec", handleInvalid="error")


def split_bins(rows: int) -> int:
    """MLlib takes a tree's split candidates from ``max(maxBins ** 2, 10 000)`` rows: bins enough that these are
    all rows (up to 2**31, where its square ends). A feature gets no more bins than it has distinct values."""
    return max(32, min(46_340, math.isqrt(max(rows - 1, 0)) + 1)) if rows > 10_000 else 32


def _fit_trees(learner, features: Sequence[str], data: DataFrame) -> PipelineModel:
    """Iterative learners re-read their input every pass: keep it cached for the fit only."""
    data = data.persist()
    try:
        return Pipeline(stages=[_assembler(features), learner.setMaxBins(split_bins(data.count()))]).fit(data)
    finally:
        data.unpersist()


def fit_logistic(train: DataFrame, features: Sequence[str], target: str = "target", C: float = 1.0,
                 max_iter: int = 500) -> PipelineModel:
    """Standardise (with mean) + class-balanced L2 logistic regression; regParam = 1 / (C * n)."""
    data = with_class_weights(train.withColumn(target, F.col(target).cast("double")), target).persist()
    n = max(data.count(), 1)
    scaler = StandardScaler(inputCol="features_vec", outputCol="scaled", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="scaled", labelCol=target, weightCol="class_weight", maxIter=max_iter,
                            regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False)
    try:
        return Pipeline(stages=[_assembler(features), scaler, lr]).fit(data)
    finally:
        data.unpersist()


def fit_forest(train: DataFrame, features: Sequence[str], target: str = "target", num_trees: int = 80,
               max_depth: int | None = 18, min_instances: int = 2, max_features: str = "sqrt", seed: int = 42) -> PipelineModel:
    depth = DEEPEST if max_depth is None else max_depth
    if depth > DEEPEST:
        raise ValueError(f"trees of depth {depth}: at most {DEEPEST} here")
    data = with_class_weights(train.withColumn(target, F.col(target).cast("double")), target)
    rf = RandomForestClassifier(featuresCol="features_vec", labelCol=target, weightCol="class_weight", numTrees=num_trees,
                                maxDepth=depth, minInstancesPerNode=min_instances, featureSubsetStrategy=max_features, seed=seed)
    return _fit_trees(rf, features, data)


def fit_gbt(train: DataFrame, features: Sequence[str], target: str = "target", max_iter: int = 200, step_size: float = 0.1,
            max_depth: int | None = 5, min_instances: int = 1, subsample: float = 1.0, seed: int = 42) -> PipelineModel:
    depth = DEEPEST if max_depth is None else max_depth
    if depth > DEEPEST:
        raise ValueError(f"trees of depth {depth}: at most {DEEPEST} here")
    data = with_class_weights(train.withColumn(target, F.col(target).cast("double")), target)
    gbt = GBTClassifier(featuresCol="features_vec", labelCol=target, weightCol="class_weight", maxIter=max_iter, stepSize=step_size,
                        maxDepth=depth, minInstancesPerNode=min_instances, subsamplingRate=subsample, seed=seed)
    return _fit_trees(gbt, features, data)


def leaf_depth(max_leaf_nodes: int | None, max_depth: int | None) -> int | None:
    """Level-wise trees have no leaf count: the depth whose full tree has as many leaves, if that is less."""
    if max_leaf_nodes is None:
        return max_depth
    depth = math.ceil(math.log2(max_leaf_nodes))
    return depth if max_depth is None else min(depth, max_depth)


def fit_family(family: str, train: DataFrame, features: Sequence[str], target: str = "target",
               params: Mapping | None = None, seed: int = 42) -> PipelineModel:
    """Fit a family with its preset, ``params`` over it."""
    if family not in FIXED_PRESETS:
        raise ValueError(f"unknown model family: {family}")
    p = {**FIXED_PRESETS[family], **(params or {})}
    if family == "logistic_regression":
        return fit_logistic(train, features, target, C=float(p["C"]), max_iter=int(p["max_iter"]))
    if family == "random_forest":
        return fit_forest(train, features, target, int(p["n_estimators"]), p["max_depth"], int(p["min_samples_leaf"]),
                          p["max_features"], seed)
    if family == "xgboost":
        return fit_gbt(train, features, target, int(p["n_estimators"]), float(p["learning_rate"]), p["max_depth"],
                       subsample=float(p["subsample"]), seed=seed)
    return fit_gbt(train, features, target, int(p["max_iter"]), float(p["learning_rate"]),
                   leaf_depth(p["max_leaf_nodes"], p["max_depth"]), int(p["min_samples_leaf"]), seed=seed)


def positive_score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``score`` = P(class 1) from the probability vector."""
    return model.transform(df).withColumn("score", vector_to_array(F.col("probability"))[1]).drop(
        "features_vec", "scaled", "rawPrediction", "probability", "prediction")


def score_table(model: PipelineModel, df: DataFrame, key: str, version: str, scored_at: Column,
                threshold: float = 0.5) -> DataFrame:
    """Batch or stream scoring: probability, class, version, time and a deterministic prediction id."""
    s = positive_score(model, df)
    bad = F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1)
    s = s.withColumn("score", F.when(bad, F.raise_error(F.lit("non-finite or out-of-range score"))).otherwise(F.col("score")))
    return s.select("*", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(version)), 256).alias("prediction_id"),
                    F.when(F.col("score") >= threshold, F.lit("ATTACK")).otherwise(F.lit("BENIGN")).alias("prediction"),
                    F.lit(version).alias("model_version"), scored_at.alias("scored_at"))


def evaluate(model: PipelineModel, df: DataFrame, target: str = "target") -> DataFrame:
    """One row: confusion counts, rates (0.0 on empty denominators), AP and ROC AUC."""
    s = positive_score(model, df).withColumn(target, F.col(target).cast("int"))
    bm = binary_metrics(s, target, "score").withColumn("_k", F.lit(1))
    rk = ranking_metrics(s, target, "score").withColumn("_k", F.lit(1))
    return bm.join(rk, "_k").drop("_k").withColumnRenamed("average_precision", "pr_auc")


def feature_importance(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """abs(scaled coefficient) for linear models, native importances for trees (driver-side, one value per feature)."""
    last = model.stages[-1]
    if hasattr(last, "coefficients"):
        vals = [float(v) for v in last.coefficients.toArray()]
        return [(f, v) for f, v in zip(features, vals)]
    vals = [float(v) for v in last.featureImportances.toArray()]
    return [(f, v) for f, v in zip(features, vals)]


def importance_frame(spark, pairs: Sequence[tuple[str, float]]) -> DataFrame:
    """(feature, importance, signed_importance, rank): rank by |importance| desc then position."""
    from pyspark.sql import Window

    rows = [(f, abs(v), v, i + 1) for i, (f, v) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "feature string, importance double, signed_importance double, position int")
    # one row per feature: the ranking window is bounded by the feature count
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "position")))


# ---- seeded random parameter search --------------------------------------------------------------
@dataclass(frozen=True)
class Space:
    kind: str  # int / float / categorical
    low: float | None = None
    high: float | None = None
    step: int = 1
    log: bool = False
    choices: tuple = field(default_factory=tuple)

    def sample(self, rng: random.Random):
        if self.kind == "int":
            k = int((self.high - self.low) // self.step)
            return int(self.low + self.step * rng.randint(0, k))
        if self.kind == "float":
            if self.log:
                return float(math.exp(rng.uniform(math.log(self.low), math.log(self.high))))
            return float(rng.uniform(self.low, self.high))
        return rng.choice(list(self.choices))


def param_search(train: DataFrame, valid: DataFrame, family: str, space: Mapping[str, Space], n_trials: int,
                 features: Sequence[str], target: str = "target", seed: int = 42, workers: int = 2) -> list[dict]:
    """Seeded random trials: one Spark fit per trial on the cached train set, scored on a fixed
    validation table (not TrainValidationSplit, which splits randomly). Failed trials are recorded."""
    rng = random.Random(seed)
    trials = [{"trial": i, "params": {k: s.sample(rng) for k, s in space.items()}} for i in range(n_trials)]
    train = train.persist()

    def run(t):
        try:
            model = fit_family(family, train, features, target, t["params"], seed)
            row = evaluate(model, valid, target).first()
            return {**t, "family": family, "state": "COMPLETE", "value": float(row["pr_auc"] or 0.0)}
        except Exception as exc:  # noqa: BLE001 - a failed trial is a result
            return {**t, "family": family, "state": "FAIL", "value": None, "error": str(exc)}

    try:
        with ThreadPoolExecutor(max_workers=workers) as pool:
            return list(pool.map(run, trials))
    finally:
        train.unpersist()


def trials_frame(spark, trials: Sequence[dict]) -> DataFrame:
    rows = [(t["family"], int(t["trial"]), t["state"], t["value"], json.dumps(t["params"], sort_keys=True)) for t in trials]
    return spark.createDataFrame(rows, "family string, trial int, state string, value double, params string")


def save_model(model: PipelineModel, path: str, features: Sequence[str], target: str = "target") -> None:
    """Persist the fitted pipeline with its input schema beside it (written through Spark)."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(path)

    ss = SparkSession.getActiveSession()
    ss.createDataFrame([(json.dumps({"feature_columns": list(features), "target_column": target}),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_schema")

"""Registered queries: Spark ML training, scoring, search and refits (rows-only checks:
model fitting has no SQL twin). Training and evaluation read whole partitions; only the gate
baseline is refitted on a stratified sample of the train partition, as in the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import written
from kestrel.operators import ml as ML
from kestrel.operators.lifecycle import params_recovery
from kestrel.operators.sampling import promotion_slice, stratified_sample
from kestrel.plans import adapters as A
from kestrel.plans.registry import register
from kestrel.session import ensure_checkpoint_dir, materialize

TRAIN_ROWS = 20000      # the gate baseline's sample
FEATS = list(A.FLOW_FEATURES)


def _parts(spark, sf):
    # fits and evaluations read the rows many times: prepared once, a folder a partition
    p = A.kept_flows(spark, sf).withColumn("target", F.col("target").cast("int"))
    train = p.filter(F.col("source_partition") == "train")
    # every row trains; dealt and ordered by digest: all cores fit, and bagging does not depend on how files were cut
    parts = max(spark.sparkContext.defaultParallelism, train.rdd.getNumPartitions())
    train = train.repartition(parts, "row_digest").sortWithinPartitions("row_digest")
    valid = p.filter(F.col("source_partition") == "validation")
    test = p.filter(F.col("source_partition") == "test")
    return train, valid, test


def _eval_row(model, df, family):
    r = ML.evaluate(model, df)
    return r.select(F.lit(family).alias("family"), "rows", "tp", "fp", "tn", "fn", "precision", "recall", "f1",
                    "false_positive_rate", "pr_auc", "roc_auc")


@register("fit_logistic")
def q_fit_logistic(spark: SparkSession, sf: str) -> DataFrame:
    train, valid, _ = _parts(spark, sf)
    return _eval_row(ML.fit_logistic(train, FEATS), valid, "logistic_regression")


@register("fit_forest")
def q_fit_forest(spark: SparkSession, sf: str) -> DataFrame:
    train, valid, _ = _parts(spark, sf)
    return _eval_row(ML.fit_family("random_forest", train, FEATS), valid, "random_forest")


@register("fit_gbt")
def q_fit_gbt(spark: SparkSession, sf: str) -> DataFrame:
    train, valid, _ = _parts(spark, sf)
    return _eval_row(ML.fit_family("hist_gradient_boosting", train, FEATS), valid, "hist_gradient_boosting")


@register("score_table")
def q_score_table(spark: SparkSession, sf: str) -> DataFrame:
    train, valid, _ = _parts(spark, sf)
    model = ML.fit_logistic(train, FEATS)
    s = ML.score_table(model, valid, "row_digest", "1", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return s.select("prediction_id", "row_digest", F.round("score", 6).alias("score"), "prediction", "model_version", "scored_at")


@register("feature_importance")
def q_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    train, _, _ = _parts(spark, sf)
    model = ML.fit_family("random_forest", train, FEATS)
    return ML.importance_frame(spark, ML.feature_importance(model, FEATS))


SPACES = {
    "logistic_regression": {"C": ML.Space("float", 1e-3, 1e2, log=True)},
    "random_forest": {"n_estimators": ML.Space("int", 10, 30, step=10), "max_depth": ML.Space("int", 4, 10, step=2)},
}


def _search(spark, sf):
    train, valid, test = _parts(spark, sf)
    trials = []
    for family, space in SPACES.items():
        trials += ML.param_search(train, valid, family, space, 2, FEATS, seed=42)
    return ML.trials_frame(spark, trials), train, valid, test


@register("param_search")
def q_param_search(spark: SparkSession, sf: str) -> DataFrame:
    t, _, _, _ = _search(spark, sf)
    return t


@register("refit_winner")
def q_refit_winner(spark: SparkSession, sf: str) -> DataFrame:
    """Refit the best trial's parameters; evaluate on validation, then test once."""
    import json

    trials, train, valid, test = _search(spark, sf)
    best = trials.filter(F.col("state") == "COMPLETE").orderBy(F.col("value").desc(), "family", "trial").first()
    model = ML.fit_family(best["family"], train, FEATS, params=json.loads(best["params"]))
    v = _eval_row(model, valid, best["family"]).withColumn("split", F.lit("validation"))
    t = _eval_row(model, test, best["family"]).withColumn("split", F.lit("test"))
    return v.unionByName(t)


@register("baseline_reference")
def q_baseline_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Refit the chosen baseline on sampled train and evaluate it on the promotion slice (gate source)."""
    train, valid, _ = _parts(spark, sf)
    train = materialize(stratified_sample(train, TRAIN_ROWS, 42, "row_digest"))
    sl = promotion_slice(valid, 2000, 42, "row_digest", min_positive_rows=50, max_positive_fraction=0.05)
    return _eval_row(ML.fit_logistic(train, FEATS), sl, "logistic_regression")


#: The champion's run as its registry holds it: parameters as text under the family's name.
CHAMPION_RUN = [("1", "logistic_regression.C", "0.5"), ("1", "logistic_regression.max_iter", "200"),
                ("1", "logistic_regression.note", "first"), ("1", "xgboost.max_depth", "6")]
TYPES = {"int": int, "float": float, "bool": lambda v: v.lower() == "true", "string": str}


def recovered(spark: SparkSession, version: str, family: str) -> dict:
    """The parameters of a version's run that its family knows, typed."""
    params = spark.createDataFrame(CHAMPION_RUN, "model_version string, key string, value string").where(F.col("model_version") == version)
    known = {k: "any" for k in ML.FIXED_PRESETS[family]}
    rows = params_recovery(params, f"{family}.", known).collect()  # one row a parameter
    return {r["param"]: TYPES[r["value_type"]](r["value"]) for r in rows}


@register("retrain_fit")
def q_retrain_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Refit the champion's family with the parameters recovered from its run on the retraining set;
    metrics on its rows and on a promotion slice of later predictions."""
    from kestrel.plans.q_dataset import retraining_set

    family, feats = "logistic_regression", list(A.MONITOR_FEATURES)
    rows = retraining_set(spark, sf).rows
    model = ML.fit_family(family, rows, feats, params=recovered(spark, "1", family))
    later = A.monitored_predictions(spark, sf).where(
        (F.col("timestamp") >= F.lit(A.SPLIT_TS).cast("timestamp_ntz")) & F.col("ground_truth").isNotNull() & F.col("value").isNotNull())
    # the slice reads its rows three times
    later = written(later.select("prediction_id", *feats, F.col("ground_truth").cast("int").alias("target")), "later")
    sl = promotion_slice(later, 2000, 42, "prediction_id")
    return _eval_row(model, rows, family).withColumn("split", F.lit("train")).unionByName(
        _eval_row(model, sl, family).withColumn("split", F.lit("slice")))


@register("save_model")
def q_save_model(spark: SparkSession, sf: str) -> DataFrame:
    """Persist a fitted pipeline (and its schema) under the shared checkpoint folder; return its file manifest."""
    import uuid

    from kestrel.sources.files import file_manifest

    train, _, _ = _parts(spark, sf)
    model = ML.fit_logistic(train, FEATS)
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/models/{uuid.uuid4().hex}/logistic"
    ML.save_model(model, path, FEATS)
    return file_manifest(spark, path + "*/**").select("relative_path", "size_bytes", "sha256")

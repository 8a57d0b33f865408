"""Classifier metrics as aggregates: confusion cells, rates, AP, ROC AUC, distributions.

Two null conventions exist on purpose (quirk Q7): model evaluation uses 0.0 on an
empty denominator (``binary_metrics``), monitoring uses null (``labelled_performance``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions import class_name, safe_div, zero_div
from kestrel.operators.ranking import running_totals


def confusion_matrix(df: DataFrame, label: str = "target", pred: str = "prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    """tp / fp / tn / fn by conditional counts; ``pred`` and ``label`` are 0/1."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 0)).alias("tn"), F.count_if((p == 0) & (y == 1)).alias("fn"))


def rates_from_confusion(cm: DataFrame) -> DataFrame:
    """accuracy, precision, recall, F1, FPR, FNR with 0.0 on an empty denominator."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision = zero_div(tp, tp + fp)
    recall = zero_div(tp, tp + fn)
    return cm.select(
        "*",
        zero_div(tp + tn, F.col("rows")).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        zero_div(2 * precision * recall, precision + recall).alias("f1"),
        zero_div(fp, fp + tn).alias("false_positive_rate"),
        zero_div(fn, fn + tp).alias("false_negative_rate"))


def binary_metrics(df: DataFrame, label: str = "target", score: str = "score", by: Sequence[str] = (),
                   threshold: float = 0.5) -> DataFrame:
    scored = df.withColumn("_pred", F.when(F.col(score) >= threshold, 1).otherwise(0))
    return rates_from_confusion(confusion_matrix(scored, label, "_pred", by))


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct (group, score) with positive and negative counts (partial aggregate)."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def cumulative_counts(df: DataFrame, label: str = "target", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Running tp / fp from the highest score down, per distinct score."""
    sc = score_counts(df, label, score, by)
    return running_totals(sc, by, "score", ["pos", "neg"], descending=True).withColumnRenamed(
        "cum_pos", "cum_tp").withColumnRenamed("cum_neg", "cum_fp")


def ranking_metrics(df: DataFrame, label: str = "target", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Average precision (step-wise, sum of dR * P over distinct scores) and tie-aware ROC AUC.

    AUC = sum(pos * (negatives below + neg / 2)) / (P * N), null with one class only.
    AP is null without positives.
    """
    cum = cumulative_counts(df, label, score, by)
    tot = cum.groupBy(*by).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.col("pos") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("_ap_num"),
        F.sum(F.col("pos") * (F.col("neg") * 0.5 - F.col("cum_fp"))).alias("_auc_part"))
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    return tot.select(
        *by, F.col("P").alias("positives"), F.col("N").alias("negatives"),
        F.when(P > 0, F.col("_ap_num") / P).alias("average_precision"),
        F.when((P > 0) & (N > 0), (F.col("_auc_part") + P * N) / (P * N)).alias("roc_auc"))


def labelled_performance(df: DataFrame, prediction: str = "prediction", truth: str = "ground_truth",
                         by: Sequence[str] = (), minimum_labelled_rows: int = 20,
                         min_attack_support: int = 1, min_benign_support: int = 1) -> DataFrame:
    """Monitoring performance: support gates first, then rates with null on empty denominators.

    ``prediction`` is the class string (ATTACK / BENIGN); unknown strings fall in no cell
    but stay in the accuracy denominator (quirk Q3).
    """
    y = F.col(truth)
    p = F.col(prediction)
    agg = df.groupBy(*by).agg(
        F.count_if(y.isNotNull()).alias("labelled_rows"),
        F.count_if(y == 1).alias("true_attack"), F.count_if(y == 0).alias("true_benign"),
        F.count_if((p == "ATTACK") & (y == 1)).alias("tp"), F.count_if((p == "BENIGN") & (y == 1)).alias("fn"),
        F.count_if((p == "ATTACK") & (y == 0)).alias("fp"), F.count_if((p == "BENIGN") & (y == 0)).alias("tn"))
    reasons = F.filter(F.array(
        F.when(F.col("labelled_rows") < minimum_labelled_rows, F.lit("minimum_labelled_rows")),
        F.when(F.col("true_attack") < min_attack_support, F.lit("min_attack_support")),
        F.when(F.col("true_benign") < min_benign_support, F.lit("min_benign_support"))), lambda r: r.isNotNull())
    ok = F.size(reasons) == 0
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall = safe_div(tp, tp + fn)
    precision = safe_div(tp, tp + fp)
    f1 = (F.when(precision.isNull() | recall.isNull(), F.lit(None).cast("double"))
          .when(precision + recall == 0, F.lit(0.0))
          .otherwise(2 * precision * recall / (precision + recall)))
    gated = lambda c: F.when(ok, c)
    return agg.select(
        *by, F.when(ok, F.lit("available")).otherwise(F.lit("insufficient_labels")).alias("status"),
        "labelled_rows", "true_attack", "true_benign", reasons.alias("insufficient_reasons"),
        gated(tp).alias("tp"), gated(fn).alias("fn"), gated(fp).alias("fp"), gated(tn).alias("tn"),
        gated(recall).alias("attack_recall"), gated(precision).alias("precision"), gated(f1).alias("f1"),
        gated(safe_div(fp, fp + tn)).alias("false_positive_rate"),
        gated(safe_div(tp + tn, F.col("labelled_rows"))).alias("accuracy"))


def class_distribution(df: DataFrame, value: Column, by: Sequence[str] = (), prefix: str = "") -> DataFrame:
    cls = class_name(value)
    agg = df.groupBy(*by).agg(F.count_if(cls == "BENIGN").alias(f"{prefix}benign_count"),
                              F.count_if(cls == "ATTACK").alias(f"{prefix}attack_count"),
                              F.count(F.lit(1)).alias(f"{prefix}total"))
    return agg.select("*", safe_div(F.col(f"{prefix}benign_count"), F.col(f"{prefix}total")).alias(f"{prefix}benign_share"),
                      safe_div(F.col(f"{prefix}attack_count"), F.col(f"{prefix}total")).alias(f"{prefix}attack_share"))


def prediction_distribution(df: DataFrame, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    return class_distribution(df, F.col(prediction), by)


def true_label_distribution(df: DataFrame, truth: str = "ground_truth", by: Sequence[str] = ()) -> DataFrame:
    """Same shape over labelled rows; a group with no labels gets null counts (never zero)."""
    y = F.col(truth)
    agg = df.groupBy(*by).agg(F.count_if(y == 1).alias("attack_count"), F.count_if(y == 0).alias("benign_count"),
                              F.count(y).alias("total"))
    has = F.col("total") > 0
    return agg.select(*by, *[F.when(has, F.col(c)).alias(c) for c in ("benign_count", "attack_count", "total")],
                      F.when(has, safe_div(F.col("benign_count"), F.col("total"))).alias("benign_share"),
                      F.when(has, safe_div(F.col("attack_count"), F.col("total"))).alias("attack_share"))


def model_version_distribution(df: DataFrame, version: str = "model_version", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(version).cast("string").alias("model_version")).agg(
        F.count(F.lit(1)).alias("rows"))


def class_balance(df: DataFrame, target: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """negatives / positives with a floor of 1, and balanced class weights n / (2 * n_class)."""
    agg = df.groupBy(*by).agg(F.count_if(F.col(target) == 0).alias("negatives"),
                              F.count_if(F.col(target) == 1).alias("positives"),
                              F.count(F.lit(1)).alias("rows"))
    return agg.select(
        "*", (F.greatest(F.col("negatives"), F.lit(1)) / F.greatest(F.col("positives"), F.lit(1))).alias("scale_pos_weight"),
        F.try_divide(F.col("rows").cast("double"), 2.0 * F.col("negatives")).alias("weight_benign"),
        F.try_divide(F.col("rows").cast("double"), 2.0 * F.col("positives")).alias("weight_attack"))


def composite_selection_score(recall: Column, f1: Column, ap: Column, roc: Column, fpr: Column) -> Column:
    """0.35 recall + 0.25 F1 + 0.25 AP + 0.10 ROC (null -> 0) + 0.05 (1 - FPR)."""
    return (0.35 * recall + 0.25 * f1 + 0.25 * F.coalesce(ap, F.lit(0.0)) + 0.10 * F.coalesce(roc, F.lit(0.0))
            + 0.05 * (1.0 - fpr))

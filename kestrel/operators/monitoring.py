"""Monitoring: latest-N window, order-insensitive fingerprints and the monitoring report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.contracts import MonitoringConfig
from kestrel.operators import drift as D
from kestrel.operators import metrics as M
from kestrel.operators.ranking import running_totals


def latest_window(preds: DataFrame, n: int, ts: str = "timestamp", key: str = "prediction_id") -> DataFrame:
    """Latest ``n`` rows by (ts desc, id desc): a bounded top-k (TakeOrderedAndProject)."""
    return preds.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def position_index(df: DataFrame, order_col: str, name: str = "request_index", tiebreak: Sequence[str] = ()) -> DataFrame:
    """0-based exact rank by a numeric ordering column (ties broken by ``tiebreak``) without a
    single-partition window: bucketed running totals give each distinct value its start offset,
    and only rows sharing one value are ranked together."""
    one = df.groupBy(order_col).agg(F.count(F.lit(1)).alias("_w"))
    ranked = running_totals(one, [], order_col, ["_w"]).select(order_col, (F.col("cum__w") - F.col("_w")).alias("_start"))
    j = df.join(ranked, order_col)
    if not tiebreak:
        return j.withColumnRenamed("_start", name)
    w = Window.partitionBy(order_col).orderBy(*tiebreak)
    return j.withColumn(name, F.col("_start") + F.row_number().over(w) - 1).drop("_start")


def digest_parts(text):
    """Two 60-bit slices of SHA-256 - summing them gives an order-insensitive multiset hash."""
    h = F.sha2(text, 256)
    return (F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)"),
            F.conv(F.substring(h, 16, 15), 16, 10).cast("decimal(38,0)"))


def dataset_fingerprint(df: DataFrame, row_text, by: Sequence[str] = ()) -> DataFrame:
    """Order-insensitive, duplicate-sensitive fingerprint (quirk Q8): one partial aggregate,
    no sort and no collected list. ``row_text`` is the canonical text (or digest) of a row."""
    a, b = digest_parts(row_text)
    agg = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(a).alias("_s1"), F.sum(b).alias("_s2"))
    text = F.concat_ws(":", F.col("rows").cast("string"), F.col("_s1").cast("string"), F.col("_s2").cast("string"))
    return agg.select(*by, "rows", F.sha2(text, 256).alias("fingerprint"))


def row_fingerprint(features: Sequence[str], target: str | None = "target"):
    """SHA-256 of canonical JSON of the sorted features (+ target). Same equivalence classes as the
    reference; hex differs where Java and Python print doubles differently (quirk Q2)."""
    cols = [F.col(c).cast("double").alias(c) for c in sorted(features)]
    if target:
        cols.append(F.col(target).cast("int").alias(target))
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def monitoring_report(window: DataFrame, reference_tall: DataFrame, features: Sequence[str], cfg: MonitoringConfig,
                      by: Sequence[str] = ()) -> DataFrame:
    """One row per group: warming_up below the minimum window (drift null, never false), else drift,
    labelled performance and distributions. ``window`` holds typed features, prediction, ground_truth."""
    by = list(by)
    if not by:
        one = monitoring_report(window.withColumn("_k", F.lit(0)), reference_tall, features, cfg, ["_k"])
        return one.drop("_k")
    size = window.groupBy(*by).agg(F.count(F.lit(1)).alias("window_rows"))
    cur_tall = D.unpivot(window, features, by)
    psi = D.psi(reference_tall, cur_tall, ["feature"], by)
    drift = D.drift_summary(psi, by, cfg.psi_threshold, cfg.drift_share_threshold)
    perf = M.labelled_performance(window, by=by, minimum_labelled_rows=cfg.minimum_labelled_rows,
                                  min_attack_support=cfg.min_attack_support, min_benign_support=cfg.min_benign_support)
    dist = M.prediction_distribution(window, by=by)
    j = (size.join(drift, by, "left").join(perf.withColumnRenamed("status", "performance_status"), by, "left")
         .join(dist, by, "left"))
    warming = F.col("window_rows") < cfg.minimum_window_size
    gate = lambda c: F.when(~warming, c)
    return j.select(
        *by, "window_rows", F.when(warming, F.lit("warming_up")).otherwise(F.lit("ok")).alias("status"),
        gate(F.col("monitored_feature_count")).alias("monitored_feature_count"),
        gate(F.col("drifting_feature_count")).alias("drifting_feature_count"),
        gate(F.col("drift_share")).alias("drift_share"),
        gate(F.col("data_drift_detected")).alias("data_drift_detected"),
        gate(F.col("drifting_features")).alias("drifting_features"),
        "performance_status", "labelled_rows", "true_attack", "true_benign",
        "attack_recall", "precision", "f1", "false_positive_rate", "accuracy",
        "attack_count", "benign_count", "attack_share")

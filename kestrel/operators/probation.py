"""Post-promotion probation: evidence window, status, severe violations, rollback plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.metrics import labelled_performance


@dataclass(frozen=True)
class ProbationConfig:
    enabled: bool = True
    duration_seconds: int = 300
    minimum_labelled_rows: int = 20
    minimum_attack_support: int = 1
    minimum_benign_support: int = 1
    automatic_rollback: bool = True
    min_attack_recall: float | None = 0.10
    min_f1: float | None = 0.05
    max_false_positive_rate: float | None = 0.25


def start_probation(promotions: DataFrame, cfg: ProbationConfig) -> DataFrame:
    """Probation row per promotion: end = start + duration; not started when disabled or without a
    previous champion. ``promotions``: probation_id, promoted_version, previous_champion_version, promoted_at."""
    reason = (F.when(F.lit(not cfg.enabled), F.lit("probation_disabled"))
              .when(F.col("previous_champion_version").isNull(), F.lit("no_previous_champion")))
    started = reason.isNull()
    return promotions.select(
        "probation_id", "promoted_version", "previous_champion_version", started.alias("started"), reason.alias("reason"),
        F.when(started, F.col("promoted_at")).alias("started_at"),
        F.when(started, F.col("promoted_at") + F.make_dt_interval(secs=F.lit(cfg.duration_seconds))).alias("ends_at"),
        F.when(started, F.lit("active")).alias("status"))


def probation_window(probations: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of the promoted version inside [start, end), labelled and approved (range filter
    after an equi-join on the version)."""
    p = probations.filter(F.col("started")).select("probation_id", F.col("promoted_version").alias("model_version"),
                                                   "started_at", "ends_at")
    o = observations.filter(F.col("ground_truth").isNotNull() & (F.col("validation_status") == "approved"))
    j = o.join(p, "model_version")
    return j.filter((F.col("timestamp") >= F.col("started_at")) & (F.col("timestamp") < F.col("ends_at")))


def severe_violations(perf: DataFrame, cfg: ProbationConfig) -> Column:
    """Null-safe guardrails: recall < min, F1 < min, FPR > max."""
    items = []
    if cfg.min_attack_recall is not None:
        items.append(F.when(F.col("attack_recall") < cfg.min_attack_recall, F.lit("severe_attack_recall_below_threshold")))
    if cfg.min_f1 is not None:
        items.append(F.when(F.col("f1") < cfg.min_f1, F.lit("severe_f1_below_threshold")))
    if cfg.max_false_positive_rate is not None:
        items.append(F.when(F.col("false_positive_rate") > cfg.max_false_positive_rate,
                            F.lit("severe_false_positive_rate_above_threshold")))
    return F.filter(F.array(*items), lambda x: x.isNotNull()) if items else F.array().cast("array<string>")


def probation_status(probations: DataFrame, window: DataFrame, cfg: ProbationConfig, now: Column) -> DataFrame:
    """rollback_triggered / inconclusive / awaiting_evidence / passed / active, with support.

    A severe violation with automatic rollback off can end as ``passed`` (quirk Q15); ``severe`` says so.
    """
    perf = labelled_performance(window, "prediction", "ground_truth", ["probation_id"], cfg.minimum_labelled_rows,
                                cfg.minimum_attack_support, cfg.minimum_benign_support)
    p = probations.filter(F.col("started")).drop("status").join(perf.withColumnRenamed("status", "perf_status"),
                                                               "probation_id", "left")
    sufficient = F.coalesce(F.col("perf_status") == "available", F.lit(False))
    reasons = F.when(sufficient, severe_violations(p, cfg)).otherwise(F.array().cast("array<string>"))
    ended = now.cast("timestamp_ntz") >= F.col("ends_at")
    severe = F.size(reasons) > 0
    status = (F.when(severe & F.lit(cfg.automatic_rollback), F.lit("rollback_triggered"))
              .when(~sufficient, F.when(ended, F.lit("inconclusive")).otherwise(F.lit("awaiting_evidence")))
              .when(ended, F.lit("passed")).otherwise(F.lit("active")))
    return p.select("probation_id", "promoted_version", "previous_champion_version", "started_at", "ends_at",
                    status.alias("probation_status"), F.coalesce("labelled_rows", F.lit(0)).alias("labelled_rows"),
                    F.coalesce("true_attack", F.lit(0)).alias("attack_support"),
                    F.coalesce("true_benign", F.lit(0)).alias("benign_support"),
                    "attack_recall", "f1", "false_positive_rate", reasons.alias("severe_violation_reasons"),
                    severe.alias("severe"))


def rollback_plan(statuses: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """One rollback per probation needing it (left anti against successful rollbacks): target is the
    previous champion; final status rolled_back, or rollback_failed without a target."""
    need = statuses.filter(F.col("probation_status") == "rollback_triggered")
    done = rollbacks.filter(F.col("succeeded")).select("probation_id").distinct()
    todo = need.join(done, "probation_id", "left_anti")
    return todo.select("probation_id", "promoted_version", F.col("previous_champion_version").alias("target_version"),
                       F.concat(F.lit("probation severe violation: "), F.array_join("severe_violation_reasons", ", ")).alias("reason"),
                       F.when(F.col("previous_champion_version").isNotNull(), F.lit("rolled_back"))
                       .otherwise(F.lit("rollback_failed")).alias("final_status"))


def first_rollback(rollbacks: DataFrame) -> DataFrame:
    return rollbacks.filter(F.col("succeeded")).groupBy("probation_id").agg(
        F.min_by(F.struct("rollback_id", "rolled_back_at", "target_version"), F.col("rolled_back_at")).alias("f")).select(
        "probation_id", "f.*")


def active_probations(statuses: DataFrame) -> DataFrame:
    return statuses.filter(F.col("probation_status").isin("active", "awaiting_evidence"))

"""Retraining decisions and datasets as table operators.

Decisions are CASE chains over report rows (one row per monitoring run); state tables
(runs, processed runs, consumed observations) are append-only event logs whose current
row is a ``max_by`` per field. ``now`` is always a parameter.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.monitoring import dataset_fingerprint
from kestrel.operators.sampling import stratified_sample
from kestrel.session import ensure_checkpoint_dir, materialize


@dataclass(frozen=True)
class TriggerConfig:
    drift_enabled: bool = True
    performance_enabled: bool = True
    minimum_labelled_rows: int = 20
    minimum_attack_support: int = 1
    minimum_benign_support: int = 1
    min_attack_recall: float | None = None
    max_false_positive_rate: float | None = None
    baseline_f1: float | None = None
    max_f1_drop: float = 0.10
    maximum_heartbeat_age_seconds: float | None = 180.0


def _arr(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _ts_seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")).cast("double") / 1e6


def performance_trigger(reports: DataFrame, cfg: TriggerConfig) -> DataFrame:
    """Support minima first (unavailable reasons), then recall / FPR / F1 thresholds."""
    unavailable = _arr(
        F.when(F.coalesce("labelled_rows", F.lit(0)) < cfg.minimum_labelled_rows, F.lit("insufficient_labelled_rows")),
        F.when(F.coalesce("true_attack", F.lit(0)) < cfg.minimum_attack_support, F.lit("insufficient_attack_support")),
        F.when(F.coalesce("true_benign", F.lit(0)) < cfg.minimum_benign_support, F.lit("insufficient_benign_support")))
    support_ok = F.size(unavailable) == 0
    min_f1 = None if cfg.baseline_f1 is None else cfg.baseline_f1 - cfg.max_f1_drop
    reasons = _arr(
        F.when(F.col("attack_recall") < cfg.min_attack_recall, F.lit("attack_recall_below_threshold"))
        if cfg.min_attack_recall is not None else F.lit(None).cast("string"),
        F.when(F.col("false_positive_rate") > cfg.max_false_positive_rate, F.lit("false_positive_rate_above_threshold"))
        if cfg.max_false_positive_rate is not None else F.lit(None).cast("string"),
        F.when(F.col("f1") < min_f1, F.lit("f1_drop_above_threshold"))
        if min_f1 is not None else F.lit(None).cast("string"))
    missing = _arr(F.when(F.col("attack_recall").isNull(), F.lit("attack_recall_unavailable")),
                   F.when(F.col("false_positive_rate").isNull(), F.lit("false_positive_rate_unavailable")),
                   F.when(F.col("f1").isNull(), F.lit("f1_unavailable")))
    return reports.select(
        "*", F.when(support_ok, reasons).otherwise(F.array().cast("array<string>")).alias("performance_reasons"),
        F.when(support_ok, missing).otherwise(unavailable).alias("performance_unavailable_reasons")).withColumn(
        "trigger_performance_degradation", F.size("performance_reasons") > 0)


def retrain_trigger(reports: DataFrame, processed: DataFrame, cfg: TriggerConfig, now: Column) -> DataFrame:
    """Order: already processed -> unhealthy / warming up -> stale heartbeat -> drift and performance.

    ``reports``: monitoring_run_id, monitoring_health, status, finished_at, last_check_timestamp,
    data_drift_detected, labelled_rows, true_attack, true_benign, attack_recall, f1, false_positive_rate.
    ``processed``: monitoring_run_id of runs already handled.
    """
    done = processed.select("monitoring_run_id").distinct().withColumn("_done", F.lit(True))
    r = performance_trigger(reports, cfg).join(done, "monitoring_run_id", "left")
    health = F.coalesce(F.col("monitoring_health"), F.lit("unhealthy"))
    status = F.coalesce(F.col("status"), health)
    ts = F.coalesce(F.col("last_check_timestamp").cast("string"), F.col("finished_at").cast("string"))
    parsed = F.try_to_timestamp(ts)
    age = _ts_seconds(now) - _ts_seconds(parsed)
    if cfg.maximum_heartbeat_age_seconds is None:
        stale = F.lit(False)
    else:
        stale = ts.isNull() | parsed.isNull() | (age > cfg.maximum_heartbeat_age_seconds)
    drift = F.coalesce(F.col("data_drift_detected") == F.lit(True), F.lit(False)) if cfg.drift_enabled else F.lit(False)
    perf = F.col("performance_reasons") if cfg.performance_enabled else F.array().cast("array<string>")
    reasons = F.array_sort(F.array_distinct(F.concat(F.when(drift, F.array(F.lit("data_drift"))).otherwise(
        F.array().cast("array<string>")), perf)))
    decision = (F.when(F.col("_done").isNotNull(), F.lit("already_processed"))
                .when(health != "healthy", F.when((health == "warming_up") | (status == "warming_up"),
                                                  F.lit("blocked_monitoring_warming_up"))
                      .otherwise(F.lit("blocked_monitoring_unhealthy")))
                .when(stale, F.lit("blocked_monitoring_stale"))
                .when(F.size(reasons) > 0, F.lit("triggered"))
                .otherwise(F.lit("not_triggered")))
    evaluated = ~decision.isin("already_processed", "blocked_monitoring_warming_up", "blocked_monitoring_unhealthy",
                               "blocked_monitoring_stale")
    return r.select(
        "monitoring_run_id", decision.alias("decision"),
        F.when(evaluated, reasons).otherwise(F.array().cast("array<string>")).alias("trigger_reasons"),
        (decision == "triggered").alias("should_retrain"),
        F.when(evaluated, drift).otherwise(F.lit(False)).alias("trigger_data_drift"),
        F.when(evaluated, F.col("trigger_performance_degradation") & F.lit(cfg.performance_enabled)).otherwise(
            F.lit(False)).alias("trigger_performance_degradation"),
        F.when(evaluated, F.col("performance_unavailable_reasons")).otherwise(F.array().cast("array<string>")).alias(
            "performance_unavailable_reasons"),
        F.when(parsed.isNotNull(), F.greatest(age, F.lit(0.0))).alias("heartbeat_age_seconds"))


def current_runs(run_events: DataFrame, key: str = "retraining_run_id", ts: str = "event_ts",
                 fields: Sequence[str] = ("status", "started_at", "finished_at", "cooldown_until", "error")) -> DataFrame:
    """Current state per run from an append-only event log: last non-null value per field."""
    return run_events.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(ts))).alias(f)
                                         for f in fields])


def run_events_for(runs: DataFrame, cooldown_seconds: int) -> DataFrame:
    """Create / finish events; finishing sets ``cooldown_until = finished + cooldown``."""
    created = runs.select("retraining_run_id", F.col("started_at").alias("event_ts"), F.lit("running").alias("status"),
                          "started_at", F.lit(None).cast("timestamp_ntz").alias("finished_at"),
                          F.lit(None).cast("timestamp_ntz").alias("cooldown_until"), F.lit(None).cast("string").alias("error"))
    finished = runs.select("retraining_run_id", F.col("finished_at").alias("event_ts"), F.col("final_status").alias("status"),
                           F.lit(None).cast("timestamp_ntz").alias("started_at"), "finished_at",
                           (F.col("finished_at") + F.make_dt_interval(secs=F.lit(cooldown_seconds))).alias("cooldown_until"),
                           F.when(F.col("final_status") == "failed", F.lit("training error")).alias("error"))
    return created.unionByName(finished)


def cooldown_state(runs: DataFrame, now: Column) -> DataFrame:
    """Last finished run; cooldown active if now < until; remaining seconds; idle / cooldown / status."""
    fin = runs.filter(F.col("finished_at").isNotNull())
    last = fin.agg(F.max_by(F.struct("retraining_run_id", "finished_at", "cooldown_until", "status"),
                            F.col("finished_at")).alias("l")).select("l.*")
    active = F.coalesce(now.cast("timestamp_ntz") < F.col("cooldown_until"), F.lit(False))
    remaining = F.when(active, _ts_seconds(F.col("cooldown_until")) - _ts_seconds(now)).otherwise(F.lit(0.0))
    terminal = F.col("status").isin("promoted", "rejected", "promotion_pending")
    state = F.when(active, F.lit("cooldown")).when(terminal, F.lit("idle")).otherwise(F.col("status"))
    return last.select("retraining_run_id", "finished_at", "cooldown_until", "status", active.alias("active"),
                       remaining.alias("remaining_seconds"), F.coalesce(state, F.lit("idle")).alias("state"))


def processed_runs(processed_events: DataFrame) -> DataFrame:
    """A monitoring run is processed unless its latest action is ``failed`` (then reclaimable)."""
    cur = processed_events.groupBy("monitoring_run_id").agg(
        F.max_by(F.struct("decision", "action_taken"), F.col("event_ts")).alias("l")).select("monitoring_run_id", "l.*")
    return cur.filter(F.col("action_taken") != "failed")


def consumed_ids(consumed: DataFrame, runs: DataFrame) -> DataFrame:
    """Consumed ids whose run is missing or did not fail."""
    j = consumed.join(runs.select("retraining_run_id", "status"), "retraining_run_id", "left")
    return j.filter(F.col("status").isNull() | (F.col("status") != "failed")).select("prediction_id").distinct()


def approved_unconsumed(observations: DataFrame, consumed: DataFrame, limit: int | None = None) -> DataFrame:
    """Approved rows not yet consumed, first-staged order, optional limit (the limit is the feature)."""
    elig = observations.filter(F.col("validation_status") == "approved").join(consumed, "prediction_id", "left_anti")
    if limit is None:
        return elig
    return elig.orderBy("staged_at", "prediction_id").limit(limit)


def retrain_action(decisions: DataFrame, enabled: bool, cooldown_active: Column, eligible: Column,
                   minimum_rows: int) -> DataFrame:
    """skipped / disabled / cooldown / deferred / run, with a reason."""
    d = F.col("decision")
    skipped = d.isin("already_processed", "blocked_monitoring_unhealthy", "blocked_monitoring_stale",
                     "blocked_monitoring_warming_up", "not_triggered")
    action = (F.when(skipped, F.lit("skipped")).when(F.lit(not enabled), F.lit("disabled"))
              .when(cooldown_active, F.lit("cooldown")).when(eligible < minimum_rows, F.lit("deferred"))
              .otherwise(F.lit("run")))
    reason = (F.when(d == "already_processed", F.lit("monitoring_run_already_processed"))
              .when(skipped, d).when(F.lit(not enabled), F.lit("retraining_disabled"))
              .when(cooldown_active, F.lit("cooldown_active"))
              .when(eligible < minimum_rows, F.lit("insufficient_new_approved_production_data"))
              .otherwise(F.lit("triggered")))
    return decisions.select("*", action.alias("action_taken"), reason.alias("reason"))


def float32_key(features: Sequence[str], target: str) -> list[Column]:
    """Canonical comparison key: features cast to float32 on both sides (quirk Q5 fixed) + target."""
    return [F.col(c).cast("float").alias(c) for c in features] + [F.col(target).cast("int").alias(target)]


def row_identity(features: Sequence[str], target: str) -> list[Column]:
    """128-bit identity of a row's float32 features (0.0 and -0.0 alike) and target, as two longs."""
    parts = [F.col(c).cast("float") + F.lit(0.0).cast("float") for c in features] + [F.col(target).cast("int")]
    present = F.array(*[p.isNotNull() for p in parts])  # nulls leave no trace in the hashes
    return [F.xxhash64(*parts, present).alias("_d1"), F.xxhash64(F.lit(11), *reversed(parts), present).alias("_d2")]


def history_digests(history: DataFrame, features: Sequence[str], target: str, buckets: int | None = None) -> DataFrame:
    """The identities of the history's rows as a table bucketed by them in the shared folder, to be kept
    from one retraining to the next: later joins read it without a shuffle."""
    spark = history.sparkSession
    name = f"history_digests_{uuid.uuid4().hex}"
    rows = history.select(*row_identity(features, target)).distinct()
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartition(n, "_d1", "_d2").write.format("parquet").option("path", f"{ensure_checkpoint_dir(spark)}/{name}")
     .bucketBy(n, "_d1", "_d2").sortBy("_d1", "_d2").saveAsTable(name))
    return spark.table(name)


def cross_source_dedup(history: DataFrame, production: DataFrame, features: Sequence[str], target: str,
                       order: Sequence[str]) -> DataFrame:
    """Production rows equal to a history row are dropped, repeats inside production keep the first (by
    ``order``). Equality on float32 features + target. ``history``: its ``history_digests`` (then only
    the production side is shuffled, and once: its repeats meet under the same identity) or its rows."""
    digests = history if "_d1" in history.columns else history.select(*row_identity(features, target)).distinct()
    prod = production.select("*", *row_identity(features, target))
    fresh = prod.join(digests, ["_d1", "_d2"], "left_anti")
    first = fresh.groupBy("_d1", "_d2").agg(F.min_by(F.struct(*production.columns), F.struct(*[F.col(o) for o in order])).alias("r"))
    return first.select("r.*")


def union_training(history: DataFrame, production: DataFrame) -> DataFrame:
    return history.unionByName(production, allowMissingColumns=True)


@dataclass(frozen=True)
class RetrainingSet:
    """Rows (features as float32, target, data_source, row_id, staged_at) and a one-row manifest."""

    rows: DataFrame
    manifest: DataFrame


def production_rows(observations: DataFrame, consumed: DataFrame, features: Sequence[str], label: str, schema_fingerprint: str,
                    limit: int | None = None) -> DataFrame:
    """Approved, unconsumed observations in staging order (all, or the first ``limit``), checked against the
    contract: one with another schema, a feature that is null or not finite, or a label but 0 and 1
    stops the assembly."""
    rows = approved_unconsumed(observations, consumed, limit)
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")) for c in features]
    whole = F.coalesce(F.forall(F.array(*finite), lambda ok: ok), F.lit(False))
    wrong = (F.when(F.coalesce(F.col("schema_fingerprint") != schema_fingerprint, F.lit(True)), F.lit("schema mismatch"))
             .when(~whole, F.lit("feature missing or not finite"))
             .when(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)), F.lit("label is neither 0 nor 1")))
    stop = F.raise_error(F.concat(F.lit("approved production row "), F.coalesce("prediction_id", F.lit("without id")), F.lit(": "), wrong))
    checked = rows.withColumn(label, F.when(wrong.isNull(), F.col(label)).otherwise(stop.cast("int")))
    return checked.select(*[F.col(c).cast("float").alias(c) for c in features], F.col(label).cast("int").alias("target"),
                          F.lit("production").alias("data_source"), F.col("prediction_id").alias("row_id"), "staged_at")


def retraining_dataset(history: DataFrame, observations: DataFrame, consumed: DataFrame, features: Sequence[str], label: str,
                       schema_fingerprint: str, history_rows: int | None, seed: int, history_key: str,
                       limit: int | None = None) -> RetrainingSet:
    """The next training set: the (sampled) train history, kept whole, and the approved, unconsumed
    production rows that equal neither one of its rows nor an earlier staged one. Both classes must
    be there. The history goes into the bucketed digest table that the production side joins."""
    hist = history if history_rows is None else stratified_sample(history, history_rows, seed, history_key, label)
    hist = materialize(hist.select(*[F.col(c).cast("float").alias(c) for c in features], F.col(label).cast("int").alias("target"),
                                   F.lit("historical").alias("data_source"), F.col(history_key).cast("string").alias("row_id"),
                                   F.lit(None).cast("timestamp_ntz").alias("staged_at")))
    prod = materialize(production_rows(observations, consumed, features, label, schema_fingerprint, limit))
    fresh = cross_source_dedup(history_digests(hist, features, "target"), prod, features, "target", ["staged_at", "row_id"])
    rows = materialize(hist.unionByName(fresh))
    classes = {r["target"]: r["count"] for r in rows.groupBy("target").count().collect()}
    if set(classes) != {0, 1}:
        raise ValueError("a retraining dataset needs rows of both classes")
    text = F.concat_ws("|", *[F.col(c).cast("decimal(18,4)").cast("string") for c in features], F.col("target").cast("string"))
    whole = dataset_fingerprint(rows.withColumn("_all", F.lit(1)), text, ["_all"])
    counts = rows.agg(F.count_if(F.col("data_source") == "historical").alias("historical_rows"),
                      F.count_if(F.col("data_source") == "production").alias("production_rows"),
                      F.count_if(F.col("target") == 0).alias("benign_rows"), F.count_if(F.col("target") == 1).alias("attack_rows"))
    manifest = counts.withColumn("_all", F.lit(1)).join(whole.drop("rows"), "_all").select(
        F.lit(history.count()).alias("history_before_sampling"), "historical_rows", F.lit(prod.count()).alias("production_available"),
        "production_rows", (F.lit(prod.count()) - F.col("production_rows")).alias("duplicates_removed"), "benign_rows", "attack_rows",
        F.lit(seed).alias("sampling_seed"), F.lit(schema_fingerprint).alias("schema_fingerprint"), "fingerprint")
    return RetrainingSet(rows, manifest)

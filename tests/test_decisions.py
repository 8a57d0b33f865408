from pyspark.sql import functions as F

from kestrel.operators import lifecycle as L
from kestrel.operators import probation as PB
from kestrel.operators import retrain as RT

REPORT = ("monitoring_run_id string, monitoring_health string, status string, finished_at string, "
          "last_check_timestamp string, data_drift_detected boolean, labelled_rows long, true_attack long, "
          "true_benign long, attack_recall double, f1 double, false_positive_rate double")
NOW = "2026-08-15 00:10:00"


def _trigger(spark, rows, cfg=None, processed=()):
    cfg = cfg or RT.TriggerConfig(min_attack_recall=0.5, max_false_positive_rate=0.2, baseline_f1=0.8)
    reports = spark.createDataFrame(rows, REPORT)
    done = spark.createDataFrame([(p,) for p in processed], "monitoring_run_id string")
    return {r.monitoring_run_id: r for r in RT.retrain_trigger(reports, done, cfg, F.lit(NOW).cast("timestamp_ntz")).collect()}


def test_trigger_cases_f11(spark):
    fresh = "2026-08-15 00:09:00"
    rows = [("drift", "healthy", "ok", fresh, fresh, True, 50, 10, 40, 0.9, 0.9, 0.01),
            ("perf", "healthy", "ok", fresh, fresh, False, 50, 10, 40, 0.2, 0.5, 0.5),
            ("both", "healthy", "ok", fresh, fresh, True, 50, 10, 40, 0.2, 0.9, 0.01),
            ("quiet", "healthy", "ok", fresh, fresh, False, 50, 10, 40, 0.9, 0.9, 0.01),
            ("warm", "warming_up", "warming_up", fresh, fresh, None, 5, 1, 4, None, None, None),
            ("stale", "healthy", "ok", "2026-08-14 00:00:00", None, True, 50, 10, 40, 0.9, 0.9, 0.01),
            ("bad_ts", "healthy", "ok", "not-a-time", None, True, 50, 10, 40, 0.9, 0.9, 0.01),
            ("few", "healthy", "ok", fresh, fresh, False, 3, 1, 2, 0.0, 0.0, 0.9),
            ("seen", "healthy", "ok", fresh, fresh, True, 50, 10, 40, 0.9, 0.9, 0.01)]
    d = _trigger(spark, rows, processed=["seen"])
    assert d["drift"].decision == "triggered" and d["drift"].trigger_reasons == ["data_drift"]
    assert d["perf"].trigger_reasons == ["attack_recall_below_threshold", "f1_drop_above_threshold",
                                         "false_positive_rate_above_threshold"]
    assert d["both"].trigger_reasons == ["attack_recall_below_threshold", "data_drift"]
    assert d["quiet"].decision == "not_triggered"
    assert d["warm"].decision == "blocked_monitoring_warming_up"
    assert d["stale"].decision == "blocked_monitoring_stale"
    assert d["bad_ts"].decision == "blocked_monitoring_stale"
    assert d["few"].decision == "not_triggered" and "insufficient_labelled_rows" in d["few"].performance_unavailable_reasons
    assert d["seen"].decision == "already_processed"


def test_consumed_ids_ignore_failed_runs_f13(spark):
    consumed = spark.createDataFrame([("p-failed", "run-failed"), ("p-rejected", "run-rejected")],
                                     "prediction_id string, retraining_run_id string")
    runs = spark.createDataFrame([("run-failed", "failed"), ("run-rejected", "rejected")], "retraining_run_id string, status string")
    assert [r.prediction_id for r in RT.consumed_ids(consumed, runs).collect()] == ["p-rejected"]


def test_cross_source_dedup_f10(spark):
    hist = spark.createDataFrame([(float(a), 10.0 * a, 100.0 * a, t) for a, t in zip(range(1, 5), [0, 1, 0, 1])],
                                 "a double, b double, c double, target int")
    prod = spark.createDataFrame([("p1", 5.0, 50.0, 500.0, 1, 1), ("p2", 1.0, 10.0, 100.0, 0, 2), ("p5", 5.0, 50.0, 500.0, 1, 3)],
                                 "prediction_id string, a double, b double, c double, target int, staged int")
    out = RT.cross_source_dedup(hist, prod, ["a", "b", "c"], "target", ["staged"]).collect()
    assert [r.prediction_id for r in out] == ["p1"]


def test_cooldown_and_run_events(spark):
    runs = spark.createDataFrame([("r1", "2026-08-15 00:00:00", "2026-08-15 00:05:00", "promoted")],
                                 "retraining_run_id string, started_at string, finished_at string, final_status string").select(
        "retraining_run_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"),
        F.col("finished_at").cast("timestamp_ntz").alias("finished_at"), "final_status")
    cur = RT.current_runs(RT.run_events_for(runs, 300))
    c = RT.cooldown_state(cur, F.lit("2026-08-15 00:07:00").cast("timestamp_ntz")).first()
    assert c.active and c.state == "cooldown" and c.remaining_seconds == 180.0
    c2 = RT.cooldown_state(cur, F.lit("2026-08-15 00:20:00").cast("timestamp_ntz")).first()
    assert not c2.active and c2.state == "idle"


def test_gates_and_promotion(spark):
    metrics = spark.createDataFrame(
        [(v, m, x) for v, vals in {"1": (0.5, 0.5, 0.5, 0.001, 0.01), "2": (0.6, 0.6, 0.6, 0.001, 0.01),
                                   "3": (0.1, 0.6, 0.6, 0.001, 0.01)}.items()
         for m, x in zip(["pr_auc", "attack_class_recall", "f1", "false_positive_rate", "inference_latency_ms_per_row"], vals)],
        "model_version string, metric string, value double")
    thr = L.derive_thresholds(metrics.filter(F.col("model_version") == "1").select("metric", "value"), L.policy_table(spark))
    t = {r.gate: r.threshold for r in thr.collect()}
    assert abs(t["pr_auc"] - 0.45) < 1e-12 and abs(t["false_positive_rate"] - 0.005) < 1e-12
    gates = L.gate_summary(L.evaluate_gates(metrics, thr))
    comp = L.composite_score(metrics, thr, L.weights_table(spark))
    cands = gates.join(comp, "model_version").withColumn("execution_mode", F.lit("smoke"))
    d = {r.model_version: r for r in L.promotion_decision(cands, F.lit("1")).collect()}
    assert d["1"].decision == "already_champion"
    assert d["2"].decision == "promoted"
    assert d["3"].decision == "rejected" and d["3"].failed_gates[0] == "pr_auc"


def test_probation_f12(spark):
    promos = spark.createDataFrame([("prob", "9", "8", "2026-08-15 00:00:00")],
                                   "probation_id string, promoted_version string, previous_champion_version string, promoted_at string"
                                   ).withColumn("promoted_at", F.col("promoted_at").cast("timestamp_ntz"))
    cfg = PB.ProbationConfig(duration_seconds=120, minimum_labelled_rows=2)
    probs = PB.start_probation(promos, cfg)
    obs = spark.createDataFrame([
        ("a", "2026-08-14 23:59:59", "9", "ATTACK", 1, "approved"), ("b", "2026-08-15 00:00:10", "2", "ATTACK", 1, "approved"),
        ("c", "2026-08-15 00:00:20", "9", "ATTACK", None, "approved"), ("d", "2026-08-15 00:00:30", "9", "ATTACK", 1, "approved"),
        ("e", "2026-08-15 00:00:40", "9", "BENIGN", 0, "approved")],
        "prediction_id string, timestamp string, model_version string, prediction string, ground_truth int, validation_status string"
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    win = PB.probation_window(probs, obs)
    s = PB.probation_status(probs, win, cfg, F.lit("2026-08-15 00:01:00").cast("timestamp_ntz")).first()
    assert (s.labelled_rows, s.attack_support, s.benign_support, s.probation_status) == (2, 1, 1, "active")
    severe = spark.createDataFrame([
        ("f", "2026-08-15 00:00:10", "9", "BENIGN", 1, "approved"), ("g", "2026-08-15 00:00:11", "9", "BENIGN", 1, "approved"),
        ("h", "2026-08-15 00:00:12", "9", "ATTACK", 0, "approved"), ("i", "2026-08-15 00:00:13", "9", "ATTACK", 0, "approved")],
        "prediction_id string, timestamp string, model_version string, prediction string, ground_truth int, validation_status string"
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    s2 = PB.probation_status(probs, PB.probation_window(probs, severe), cfg, F.lit("2026-08-15 00:01:00").cast("timestamp_ntz"))
    assert s2.first().probation_status == "rollback_triggered"
    plan = PB.rollback_plan(s2, spark.createDataFrame([], "probation_id string, succeeded boolean")).collect()
    assert len(plan) == 1 and plan[0].final_status == "rolled_back" and plan[0].target_version == "8"
    done = spark.createDataFrame([("prob", True)], "probation_id string, succeeded boolean")
    assert PB.rollback_plan(s2, done).count() == 0  # one automatic rollback only

"""Registered queries: retraining triggers, run state, consumption and the retraining dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import retrain as RT
from kestrel.plans import adapters as A
from kestrel.plans import oracle as O
from kestrel.plans.q_monitor import _report_sql, daily_reports
from kestrel.plans.registry import register
from kestrel.session import materialize

NOW = "2024-01-31 00:00:00"
_CONSUMED_OK = """consumed_ok AS (SELECT DISTINCT c.prediction_id FROM consumed c LEFT JOIN retraining_runs r USING (retraining_run_id)
                WHERE r.final_status IS NULL OR r.final_status <> 'failed')"""
TRIGGER = RT.TriggerConfig(min_attack_recall=0.3, max_false_positive_rate=0.5, baseline_f1=0.4, max_f1_drop=0.1,
                           maximum_heartbeat_age_seconds=7 * 86400)
COOLDOWN_SECONDS = 3 * 86400


def now_col():
    return F.lit(NOW).cast("timestamp_ntz")


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Monitoring reports per (day, version) as the trigger's input (small: materialized once)."""
    r = materialize(daily_reports(spark, sf))
    fin = F.to_timestamp_ntz(F.col("report_day")) + F.expr("INTERVAL 86399 SECONDS")
    return r.select(
        F.concat(F.lit("mon-"), F.col("report_day"), F.lit("-v"), F.col("model_version")).alias("monitoring_run_id"),
        "report_day", "model_version", "status", fin.alias("finished_at"),
        F.when(F.col("model_version") == "3", F.lit(None).cast("timestamp_ntz")).otherwise(fin).alias("last_check_timestamp"),
        F.when(F.col("status") == "warming_up", F.lit("warming_up"))
        .when(F.col("report_day").endswith("3"), F.lit("unhealthy")).otherwise(F.lit("healthy")).alias("monitoring_health"),
        "data_drift_detected", "drift_share", "labelled_rows", "true_attack", "true_benign", "attack_recall", "f1",
        "false_positive_rate")


def processed_set(reports: DataFrame) -> DataFrame:
    return reports.filter(F.col("report_day") < "2024-01-05").select("monitoring_run_id")


_DAILY = _report_sql(
    """win AS (SELECT *, strftime("timestamp", '%Y-%m-%d') AS report_day FROM monitored)""", "report_day, model_version",
    "report_day, model_version, ")
_cut = _DAILY.rindex("\nSELECT ")
_REPORTS_SQL = _DAILY[:_cut] + ",\ndaily AS (" + _DAILY[_cut + 1:] + """),
reports AS (
  SELECT 'mon-' || report_day || '-v' || model_version AS monitoring_run_id, report_day, model_version, status,
         CAST(report_day AS TIMESTAMP) + INTERVAL 86399 SECOND AS finished_at,
         CASE WHEN model_version = '3' THEN NULL ELSE CAST(report_day AS TIMESTAMP) + INTERVAL 86399 SECOND END AS last_check_timestamp,
         CASE WHEN status = 'warming_up' THEN 'warming_up' WHEN ends_with(report_day, '3') THEN 'unhealthy' ELSE 'healthy' END
           AS monitoring_health,
         data_drift_detected, drift_share, labelled_rows, true_attack, true_benign, attack_recall, f1, false_positive_rate
  FROM daily
),
tperf AS (
  SELECT *, list_filter([CASE WHEN COALESCE(labelled_rows, 0) < 20 THEN 'insufficient_labelled_rows' END,
                         CASE WHEN COALESCE(true_attack, 0) < 1 THEN 'insufficient_attack_support' END,
                         CASE WHEN COALESCE(true_benign, 0) < 1 THEN 'insufficient_benign_support' END], lambda x: x IS NOT NULL) AS unavail
  FROM reports
),
tperf2 AS (
  SELECT *, CASE WHEN len(unavail) = 0 THEN list_filter([
              CASE WHEN attack_recall < 0.3 THEN 'attack_recall_below_threshold' END,
              CASE WHEN false_positive_rate > 0.5 THEN 'false_positive_rate_above_threshold' END,
              CASE WHEN f1 < 0.4 - 0.1 THEN 'f1_drop_above_threshold' END], lambda x: x IS NOT NULL) ELSE [] END AS perf_reasons,
            CASE WHEN len(unavail) = 0 THEN list_filter([
              CASE WHEN attack_recall IS NULL THEN 'attack_recall_unavailable' END,
              CASE WHEN false_positive_rate IS NULL THEN 'false_positive_rate_unavailable' END,
              CASE WHEN f1 IS NULL THEN 'f1_unavailable' END], lambda x: x IS NOT NULL) ELSE unavail END AS perf_unavail,
            date_diff('microsecond', COALESCE(last_check_timestamp, finished_at), TIMESTAMP '""" + NOW + """') / 1e6 AS age
  FROM tperf
),
decided AS (
  SELECT *, list_sort(list_distinct(list_concat(CASE WHEN COALESCE(data_drift_detected = true, false) THEN ['data_drift'] ELSE [] END,
                                                perf_reasons))) AS reasons,
         CASE WHEN report_day < '2024-01-05' THEN 'already_processed'
              WHEN monitoring_health <> 'healthy' THEN CASE WHEN monitoring_health = 'warming_up' OR status = 'warming_up'
                   THEN 'blocked_monitoring_warming_up' ELSE 'blocked_monitoring_unhealthy' END
              WHEN age > 604800 THEN 'blocked_monitoring_stale'
              WHEN len(list_distinct(list_concat(CASE WHEN COALESCE(data_drift_detected = true, false) THEN ['data_drift'] ELSE [] END,
                                                perf_reasons))) > 0 THEN 'triggered'
              ELSE 'not_triggered' END AS decision
  FROM tperf2
),
trig AS (
  SELECT monitoring_run_id, decision,
         CASE WHEN decision IN ('triggered', 'not_triggered') THEN array_to_string(reasons, '|') ELSE '' END AS trigger_reasons,
         decision = 'triggered' AS should_retrain,
         CASE WHEN decision IN ('triggered', 'not_triggered') THEN COALESCE(data_drift_detected = true, false) ELSE false END
           AS trigger_data_drift,
         CASE WHEN decision IN ('triggered', 'not_triggered') THEN len(perf_reasons) > 0 ELSE false END
           AS trigger_performance_degradation,
         CASE WHEN decision IN ('triggered', 'not_triggered') THEN array_to_string(perf_unavail, '|') ELSE '' END
           AS performance_unavailable_reasons,
         round(greatest(age, 0.0), 3) AS heartbeat_age_seconds
  FROM decided
)"""


def _trigger(spark, sf):
    reports = report_rows(spark, sf)
    return RT.retrain_trigger(reports, processed_set(reports), TRIGGER, now_col())


def _trigger_out(t: DataFrame) -> DataFrame:
    return t.select("monitoring_run_id", "decision", F.array_join("trigger_reasons", "|").alias("trigger_reasons"),
                    "should_retrain", "trigger_data_drift", "trigger_performance_degradation",
                    F.array_join("performance_unavailable_reasons", "|").alias("performance_unavailable_reasons"),
                    F.round("heartbeat_age_seconds", 3).alias("heartbeat_age_seconds"))


MON_SQL_PREFIX = O.with_ctes(O.PREDICTIONS, O.MONITORED)


def _full(sql_tail: str, extra_ctes: str = "") -> str:
    """Daily report SQL nested as a CTE, then the decision CTEs, then the tail."""
    return _REPORTS_SQL + (("," + extra_ctes) if extra_ctes else "") + "\n" + sql_tail


@register("retrain_trigger", _full("SELECT * FROM trig"))
def q_retrain_trigger(spark: SparkSession, sf: str) -> DataFrame:
    return _trigger_out(_trigger(spark, sf))


@register("performance_trigger", _full("""SELECT monitoring_run_id, array_to_string(perf_reasons, '|') AS performance_reasons,
       array_to_string(perf_unavail, '|') AS performance_unavailable_reasons, len(perf_reasons) > 0 AS trigger_performance_degradation
FROM tperf2"""))
def q_performance_trigger(spark: SparkSession, sf: str) -> DataFrame:
    p = RT.performance_trigger(report_rows(spark, sf), TRIGGER)
    return p.select("monitoring_run_id", F.array_join("performance_reasons", "|").alias("performance_reasons"),
                    F.array_join("performance_unavailable_reasons", "|").alias("performance_unavailable_reasons"),
                    "trigger_performance_degradation")


@register("heartbeat_age", _full("""SELECT monitoring_run_id, round(age, 3) AS age_seconds, age > 604800 AS stale FROM tperf2"""))
def q_heartbeat_age(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.functions import heartbeat_age, is_stale
    r = report_rows(spark, sf)
    age = heartbeat_age(F.col("last_check_timestamp"), F.col("finished_at"), now_col())
    return r.select("monitoring_run_id", F.round(age, 3).alias("age_seconds"), is_stale(age, 7 * 86400).alias("stale"))


RUN_SQL = O.with_ctes(O.RUNS)


def _runs(spark, sf):
    return RT.current_runs(RT.run_events_for(A.retraining_runs(spark, sf), COOLDOWN_SECONDS))


@register("append_run_events", RUN_SQL + """
SELECT retraining_run_id, final_status AS status, started_at, finished_at,
       finished_at + INTERVAL 259200 SECOND AS cooldown_until, CASE WHEN final_status = 'failed' THEN 'training error' END AS error
FROM retraining_runs""")
def q_append_run_events(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf)


@register("cooldown_state", RUN_SQL + """,
cur AS (SELECT retraining_run_id, final_status AS status, finished_at, finished_at + INTERVAL 259200 SECOND AS cooldown_until
        FROM retraining_runs),
last AS (SELECT * FROM cur ORDER BY finished_at DESC LIMIT 1)
SELECT retraining_run_id, finished_at, cooldown_until, status,
       TIMESTAMP '""" + NOW + """' < cooldown_until AS active,
       CASE WHEN TIMESTAMP '""" + NOW + """' < cooldown_until
            THEN date_diff('microsecond', TIMESTAMP '""" + NOW + """', cooldown_until) / 1e6 ELSE 0.0 END AS remaining_seconds,
       CASE WHEN TIMESTAMP '""" + NOW + """' < cooldown_until THEN 'cooldown'
            WHEN status IN ('promoted', 'rejected', 'promotion_pending') THEN 'idle' ELSE status END AS state
FROM last""")
def q_cooldown_state(spark: SparkSession, sf: str) -> DataFrame:
    return RT.cooldown_state(_runs(spark, sf), now_col())


@register("latest_run", RUN_SQL + """
SELECT retraining_run_id, final_status AS status, started_at FROM retraining_runs ORDER BY started_at DESC LIMIT 1""")
def q_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    last = runs.agg(F.max_by(F.struct("retraining_run_id", "status", "started_at"), F.col("started_at")).alias("l"))
    return last.select("l.*")


OBS_SQL = O.with_ctes(O.PREDICTIONS, O.LABEL_EVENTS, O.RUNS, O.OBSERVATIONS)


@register("consumed_ids", OBS_SQL + """
SELECT DISTINCT c.prediction_id FROM consumed c LEFT JOIN retraining_runs r USING (retraining_run_id)
WHERE r.final_status IS NULL OR r.final_status <> 'failed'""")
def q_consumed_ids(spark: SparkSession, sf: str) -> DataFrame:
    return RT.consumed_ids(A.consumed_observations(spark, sf), _runs(spark, sf))





@register("eligible_observations", OBS_SQL + "," + _CONSUMED_OK + """
SELECT prediction_id FROM observations WHERE validation_status = 'approved'
  AND prediction_id NOT IN (SELECT prediction_id FROM consumed_ok)""")
def q_eligible_observations(spark: SparkSession, sf: str) -> DataFrame:
    c = RT.consumed_ids(A.consumed_observations(spark, sf), _runs(spark, sf))
    return RT.approved_unconsumed(A.observations(spark, sf), c).select("prediction_id")


@register("approved_unconsumed", OBS_SQL + "," + _CONSUMED_OK + """
SELECT prediction_id, staged_at FROM observations WHERE validation_status = 'approved'
  AND prediction_id NOT IN (SELECT prediction_id FROM consumed_ok) ORDER BY staged_at, prediction_id LIMIT 1000""")
def q_approved_unconsumed(spark: SparkSession, sf: str) -> DataFrame:
    c = RT.consumed_ids(A.consumed_observations(spark, sf), _runs(spark, sf))
    return RT.approved_unconsumed(A.observations(spark, sf), c, limit=1000).select("prediction_id", "staged_at")


@register("scan_observations", OBS_SQL + """
SELECT prediction_id, staged_at, validation_status FROM observations WHERE validation_status = 'rejected'
ORDER BY staged_at, prediction_id LIMIT 200""")
def q_scan_observations(spark: SparkSession, sf: str) -> DataFrame:
    o = A.observations(spark, sf).filter(F.col("validation_status") == "rejected")
    return o.orderBy("staged_at", "prediction_id").limit(200).select("prediction_id", "staged_at", "validation_status")


@register("processed_runs", _full("""SELECT monitoring_run_id, decision, action_taken FROM (
  SELECT monitoring_run_id, decision, CASE WHEN right(monitoring_run_id, 2) = 'v2' AND decision = 'triggered' THEN 'failed'
         WHEN decision = 'triggered' THEN 'run' ELSE 'skipped' END AS action_taken FROM trig) WHERE action_taken <> 'failed'"""))
def q_processed_runs(spark: SparkSession, sf: str) -> DataFrame:
    t = _trigger(spark, sf)
    action = (F.when(F.col("monitoring_run_id").endswith("v2") & (F.col("decision") == "triggered"), F.lit("failed"))
              .when(F.col("decision") == "triggered", F.lit("run")).otherwise(F.lit("skipped")))
    events = t.select("monitoring_run_id", "decision", action.alias("action_taken"), F.lit(NOW).cast("timestamp_ntz").alias("event_ts"))
    return RT.processed_runs(events)


@register("retrain_action", _full("""SELECT t.monitoring_run_id, t.decision,
       CASE WHEN t.decision IN ('already_processed', 'blocked_monitoring_unhealthy', 'blocked_monitoring_stale',
                                'blocked_monitoring_warming_up', 'not_triggered') THEN 'skipped'
            WHEN cd.active THEN 'cooldown' WHEN el.n < 10 THEN 'deferred' ELSE 'run' END AS action_taken,
       CASE WHEN t.decision = 'already_processed' THEN 'monitoring_run_already_processed'
            WHEN t.decision IN ('blocked_monitoring_unhealthy', 'blocked_monitoring_stale', 'blocked_monitoring_warming_up',
                                'not_triggered') THEN t.decision
            WHEN cd.active THEN 'cooldown_active' WHEN el.n < 10 THEN 'insufficient_new_approved_production_data'
            ELSE 'triggered' END AS reason
FROM trig t, cd, el""", extra_ctes=",".join(x.strip() for x in (O.LABEL_EVENTS, O.RUNS, O.OBSERVATIONS)) + "," + _CONSUMED_OK + """,
cd AS (SELECT TIMESTAMP '""" + NOW + """' < max(finished_at) + INTERVAL 259200 SECOND AS active FROM retraining_runs),
el AS (SELECT count(*) AS n FROM observations WHERE validation_status = 'approved'
       AND prediction_id NOT IN (SELECT prediction_id FROM consumed_ok))"""))
def q_retrain_action(spark: SparkSession, sf: str) -> DataFrame:
    t = _trigger(spark, sf)
    cd = RT.cooldown_state(_runs(spark, sf), now_col()).select(F.lit(1).alias("_k"), F.col("active").alias("_active"))
    kept = A.kept_observations(spark, sf)
    c = RT.consumed_ids(A.consumed_observations(spark, sf, kept), _runs(spark, sf))
    el = RT.approved_unconsumed(kept, c).agg(F.count(F.lit(1)).alias("_eligible")).withColumn(
        "_k", F.lit(1))
    j = t.withColumn("_k", F.lit(1)).join(cd, "_k").join(el, "_k")
    a = RT.retrain_action(j, True, F.col("_active"), F.col("_eligible"), 10)
    return a.select("monitoring_run_id", "decision", "action_taken", "reason")

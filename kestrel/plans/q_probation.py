"""Registered queries: probation windows, status, severe violations and rollbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import probation as PB
from kestrel.plans import adapters as A
from kestrel.plans import oracle as O
from kestrel.plans.registry import register

PCFG = PB.ProbationConfig(duration_seconds=21600)
PNOW = "2024-01-30 09:00:00"
PSQL = O.with_ctes(O.PREDICTIONS, O.LABEL_EVENTS, O.RUNS, O.OBSERVATIONS, O.PROBATION)


def _now():
    return F.lit(PNOW).cast("timestamp_ntz")


def _probations(spark, sf):
    return PB.start_probation(A.promotions(spark, sf), PCFG)


def _window(spark, sf):
    return PB.probation_window(_probations(spark, sf), A.probation_observations(spark, sf))


def _status(spark, sf):
    return PB.probation_status(_probations(spark, sf), _window(spark, sf), PCFG, _now())


def _r(c):
    return F.round(c, 6).alias(c)


@register("start_probation", PSQL + """
SELECT probation_id, promoted_version, previous_champion_version, started, reason, started_at, ends_at,
       CASE WHEN started THEN 'active' END AS status FROM probations""")
def q_start_probation(spark: SparkSession, sf: str) -> DataFrame:
    return _probations(spark, sf)


@register("probation_window", PSQL + "\nSELECT probation_id, count(*) AS rows FROM pwin GROUP BY ALL")
def q_probation_window(spark: SparkSession, sf: str) -> DataFrame:
    return _window(spark, sf).groupBy("probation_id").agg(F.count(F.lit(1)).alias("rows"))


@register("probation_join", PSQL + """
SELECT model_version, count(*) AS rows, count(ground_truth) AS labelled FROM pobs GROUP BY ALL""")
def q_probation_join(spark: SparkSession, sf: str) -> DataFrame:
    j = A.probation_observations(spark, sf)
    return j.groupBy("model_version").agg(F.count(F.lit(1)).alias("rows"), F.count("ground_truth").alias("labelled"))


@register("probation_status", PSQL + """
SELECT probation_id, probation_status, labelled_rows, attack_support, benign_support, round(attack_recall, 6) AS attack_recall,
       round(f1, 6) AS f1, round(false_positive_rate, 6) AS false_positive_rate FROM pstatus""")
def q_probation_status(spark: SparkSession, sf: str) -> DataFrame:
    s = _status(spark, sf)
    return s.select("probation_id", "probation_status", "labelled_rows", "attack_support", "benign_support",
                    _r("attack_recall"), _r("f1"), _r("false_positive_rate"))


@register("severe_violations", PSQL + """
SELECT probation_id, array_to_string(severe_violation_reasons, '|') AS severe_violation_reasons,
       len(severe_violation_reasons) > 0 AS severe FROM pstatus""")
def q_severe_violations(spark: SparkSession, sf: str) -> DataFrame:
    s = _status(spark, sf)
    return s.select("probation_id", F.array_join("severe_violation_reasons", "|").alias("severe_violation_reasons"), "severe")


@register("rollback_plan", PSQL + """
SELECT probation_id, promoted_version, previous_champion_version AS target_version,
       'probation severe violation: ' || array_to_string(severe_violation_reasons, ', ') AS reason,
       CASE WHEN previous_champion_version IS NOT NULL THEN 'rolled_back' ELSE 'rollback_failed' END AS final_status
FROM pstatus WHERE probation_status = 'rollback_triggered'
  AND probation_id NOT IN (SELECT probation_id FROM rollbacks WHERE succeeded)""")
def q_rollback_plan(spark: SparkSession, sf: str) -> DataFrame:
    return PB.rollback_plan(_status(spark, sf), A.rollback_events(spark, sf))


@register("first_rollback", PSQL + """
SELECT probation_id, arg_min(rollback_id, rolled_back_at) AS rollback_id, min(rolled_back_at) AS rolled_back_at,
       arg_min(target_version, rolled_back_at) AS target_version FROM rollbacks WHERE succeeded GROUP BY probation_id""")
def q_first_rollback(spark: SparkSession, sf: str) -> DataFrame:
    return PB.first_rollback(A.rollback_events(spark, sf))


@register("active_probations", PSQL + """
SELECT probation_id, probation_status, started_at FROM pstatus WHERE probation_status IN ('active', 'awaiting_evidence')""")
def q_active_probations(spark: SparkSession, sf: str) -> DataFrame:
    return PB.active_probations(_status(spark, sf)).select("probation_id", "probation_status", "started_at")


@register("resilience_summary", PSQL + """,
act AS (SELECT * FROM pstatus WHERE probation_status IN ('active', 'awaiting_evidence'))
SELECT (SELECT arg_min(probation_id, started_at) FROM act) AS active_probation_id, (SELECT count(*) FROM act) AS active_count,
       (SELECT arg_max(probation_id, started_at) FROM pstatus) AS latest_probation_id,
       (SELECT arg_max(rollback_id, rolled_back_at) FROM rollbacks) AS latest_rollback_id""")
def q_resilience_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = _status(spark, sf)
    act = PB.active_probations(s).agg(F.min_by("probation_id", "started_at").alias("active_probation_id"),
                                      F.count(F.lit(1)).alias("active_count"))
    latest = s.agg(F.max_by("probation_id", "started_at").alias("latest_probation_id"))
    rb = A.rollback_events(spark, sf).agg(F.max_by("rollback_id", "rolled_back_at").alias("latest_rollback_id"))
    k = F.lit(1).alias("_k")
    return (act.select("*", k).join(latest.select("*", k), "_k").join(rb.select("*", k), "_k")
            .select("active_probation_id", "active_count", "latest_probation_id", "latest_rollback_id"))

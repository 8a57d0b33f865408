"""Registered queries: thresholds, gates, composite score, promotion and lifecycle state.

Inputs are per-version evaluation metrics computed from the labelled prediction log;
version '1' is the baseline and the bootstrap champion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import lifecycle as L
from kestrel.operators.metrics import composite_selection_score
from kestrel.plans import adapters as A
from kestrel.plans import oracle as O
from kestrel.plans.registry import register
from kestrel.session import materialize

LC = O.with_ctes(O.PREDICTIONS, O.LABEL_EVENTS, O.VERSION_METRICS)
SMOKE_MAX_ROWS = 10_000
CHAMPION = "1"


def _metrics(spark, sf):
    # a handful of rows per version, read by every decision below: checkpoint once
    return materialize(A.version_metrics(spark, sf))


def _thresholds(spark, m):
    base = m.filter(F.col("model_version") == CHAMPION).select("metric", "value")
    return L.derive_thresholds(base, L.policy_table(spark))


def _candidates(spark, sf):
    m = _metrics(spark, sf)
    thr = _thresholds(spark, m)
    gates = L.gate_summary(L.evaluate_gates(m.select("model_version", "metric", "value"), thr))
    comp = L.composite_score(m.select("model_version", "metric", "value"), thr, L.weights_table(spark))
    rows = m.select("model_version", "rows").distinct()
    mode = L.execution_mode(F.lit(None).cast("string"), F.col("rows"), SMOKE_MAX_ROWS)
    return gates.join(comp, "model_version").join(rows.select("model_version", mode.alias("execution_mode")), "model_version")


def _r(c, n=6):
    return F.round(c, n)


@register("version_metrics", LC + "\nSELECT model_version, rows, metric, round(value, 6) AS value FROM version_metrics")
def q_version_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return A.version_metrics(spark, sf).withColumn("value", _r("value"))


@register("derive_thresholds", LC + """
SELECT gate, source_metric, direction, round(baseline, 6) AS baseline, round(threshold, 6) AS threshold FROM thresholds""")
def q_derive_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    t = _thresholds(spark, _metrics(spark, sf))
    return t.select("gate", "source_metric", "direction", _r("baseline").alias("baseline"), _r("threshold").alias("threshold"))


@register("gates_join", LC + """
SELECT model_version, gate, round(candidate, 6) AS candidate, round(threshold, 6) AS threshold, passed, operator FROM gates""")
def q_gates_join(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    g = L.evaluate_gates(m.select("model_version", "metric", "value"), _thresholds(spark, m))
    return g.select("model_version", "gate", _r("candidate").alias("candidate"), _r("threshold").alias("threshold"),
                    "passed", "operator")


@register("evaluate_gates", LC + "\nSELECT model_version, gates_passed, failed_gates FROM gate_sum")
def q_evaluate_gates(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    g = L.gate_summary(L.evaluate_gates(m.select("model_version", "metric", "value"), _thresholds(spark, m)))
    return g.select("model_version", "gates_passed", F.array_join("failed_gates", "|").alias("failed_gates"))


@register("composite_score", LC + "\nSELECT model_version, round(composite_score, 6) AS composite_score FROM composite")
def q_composite_score(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    c = L.composite_score(m.select("model_version", "metric", "value"), _thresholds(spark, m), L.weights_table(spark))
    return c.select("model_version", _r("composite_score").alias("composite_score"))


@register("execution_mode", LC + """
SELECT model_version, rows, CASE WHEN rows <= 10000 THEN 'smoke' ELSE 'full' END AS execution_mode FROM vwide""")
def q_execution_mode(spark: SparkSession, sf: str) -> DataFrame:
    rows = _metrics(spark, sf).select("model_version", "rows").distinct()
    return rows.select("model_version", "rows",
                       L.execution_mode(F.lit(None).cast("string"), F.col("rows"), SMOKE_MAX_ROWS).alias("execution_mode"))


def _decisions(spark, sf):
    return L.promotion_decision(_candidates(spark, sf), F.lit(CHAMPION))


@register("candidate_vs_champion", LC + """
SELECT model_version, CASE WHEN cmp THEN round(delta, 6) END AS score_delta,
       CAST(CASE WHEN cmp THEN delta >= 0.01 END AS VARCHAR) AS improvement_passed FROM decision""")
def q_candidate_vs_champion(spark: SparkSession, sf: str) -> DataFrame:
    d = _decisions(spark, sf)
    return d.select("model_version", _r("score_delta").alias("score_delta"),
                    F.when(F.col("score_delta").isNotNull(), F.col("score_delta") >= L.MINIMUM_RELATIVE_IMPROVEMENT
                           ).cast("string").alias("improvement_passed"))


@register("promotion_decision", LC + """
SELECT model_version, decision, decision IN ('promoted') OR (decision = 'already_champion' AND gates_passed) AS passed,
       CASE WHEN decision = 'rejected' THEN
         array_to_string(list_concat(CASE WHEN failed_gates = '' THEN [] ELSE string_split(failed_gates, '|') END,
           CASE WHEN NOT mode_ok THEN ['execution_mode'] WHEN delta < 0.01 THEN ['composite_improvement'] ELSE [] END), '|')
       ELSE '' END AS failed_gates
FROM decision""")
def q_promotion_decision(spark: SparkSession, sf: str) -> DataFrame:
    d = _decisions(spark, sf)
    return d.select("model_version", "decision", "passed", F.array_join("failed_gates", "|").alias("failed_gates"))


def _events(spark, sf):
    """Lifecycle event log: registration, decision and supersession events per version."""
    d = _decisions(spark, sf)
    t0 = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    v = F.col("model_version").cast("int")
    reg = d.select("model_version", (t0 + F.make_dt_interval(hours=v)).alias("event_ts"), F.lit(0).alias("seq"),
                   F.lit("candidate").alias("state"))
    outcome = F.when(F.col("decision").isin("promoted", "already_champion"), F.lit("champion")).otherwise(F.lit("rejected"))
    dec = d.select("model_version", (t0 + F.make_dt_interval(hours=v, mins=F.lit(30))).alias("event_ts"),
                   F.lit(1).alias("seq"), outcome.alias("state"))
    promoted = d.filter(F.col("decision") == "promoted").agg(F.min("model_version").alias("first_promoted"))
    sup = d.filter(F.col("decision") == "already_champion").withColumn("_k", F.lit(1)).join(
        promoted.withColumn("_k", F.lit(1)), "_k").filter(F.col("first_promoted").isNotNull()).select(
        "model_version", (t0 + F.make_dt_interval(hours=F.col("first_promoted").cast("int"), mins=F.lit(31))).alias("event_ts"),
        F.lit(2).alias("seq"), F.lit("superseded").alias("state"))
    return reg.unionByName(dec).unionByName(sup)


_EVENTS_SQL = """,
events AS (
  SELECT model_version, TIMESTAMP '2024-02-01 00:00:00' + to_hours(CAST(model_version AS INTEGER)) AS event_ts, 0 AS seq,
         'candidate' AS state FROM decision
  UNION ALL
  SELECT model_version, TIMESTAMP '2024-02-01 00:00:00' + to_hours(CAST(model_version AS INTEGER)) + INTERVAL 30 MINUTE, 1,
         CASE WHEN decision IN ('promoted', 'already_champion') THEN 'champion' ELSE 'rejected' END FROM decision
  UNION ALL
  SELECT d.model_version, TIMESTAMP '2024-02-01 00:00:00' + to_hours(CAST(p.fp AS INTEGER)) + INTERVAL 31 MINUTE, 2, 'superseded'
  FROM decision d, (SELECT min(model_version) AS fp FROM decision WHERE decision = 'promoted') p
  WHERE d.decision = 'already_champion' AND p.fp IS NOT NULL
),
states AS (
  SELECT e.model_version, arg_max(e.state, (e.event_ts, e.seq)) AS state, max(e.event_ts) AS last_event_ts FROM events e GROUP BY ALL
),
champ AS (SELECT arg_max(model_version, (event_ts, seq)) AS cv FROM events WHERE state = 'champion'),
lstate AS (SELECT s.*, s.model_version = c.cv AS is_champion FROM states s, champ c)"""


def _states(spark, sf):
    return L.lifecycle_state(_events(spark, sf))


@register("lifecycle_state", LC + _EVENTS_SQL + "\nSELECT model_version, state, last_event_ts, is_champion FROM lstate")
def q_lifecycle_state(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf)


def _metadata(spark, sf):
    m = _metrics(spark, sf).select("model_version").distinct()
    v = F.col("model_version")
    return m.select("model_version", F.lit("full").alias("execution_mode"), F.lit("false").alias("demo_model"),
                    F.when(v == "1", F.lit("hist_gradient_boosting")).when(v == "2", F.lit("xgboost")).otherwise(F.lit("random_forest")).alias("model_family"),
                    F.when(v != "3", F.concat(F.lit("run-"), v)).alias("source_run_id"),
                    F.concat(F.lit("models:/ids/"), v).alias("source_model_uri"))


_META_SQL = """,
meta AS (SELECT model_version, 'full' AS execution_mode, 'false' AS demo_model,
                CASE model_version WHEN '1' THEN 'hist_gradient_boosting' WHEN '2' THEN 'xgboost' ELSE 'random_forest' END AS model_family,
                CASE WHEN model_version <> '3' THEN 'run-' || model_version END AS source_run_id,
                'models:/ids/' || model_version AS source_model_uri FROM decision)"""


@register("rollback_eligibility", LC + _EVENTS_SQL + _META_SQL + """
SELECT s.model_version, s.state,
       CASE WHEN s.state NOT IN ('champion', 'superseded') THEN 'invalid_target_state'
            WHEN m.source_run_id IS NULL THEN 'missing_metadata' WHEN m.source_model_uri IS NULL THEN 'missing_source_uri'
            WHEN s.is_champion THEN 'already_current' ELSE 'eligible' END AS rollback_status,
       CASE WHEN m.source_run_id IS NULL THEN 'source_run_id' ELSE '' END AS missing_metadata
FROM lstate s LEFT JOIN meta m USING (model_version)""")
def q_rollback_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    r = L.rollback_eligibility(_states(spark, sf), _metadata(spark, sf))
    return r.select("model_version", "state", "rollback_status", F.array_join("missing_metadata", "|").alias("missing_metadata"))


@register("model_listing", LC + _EVENTS_SQL + _META_SQL + """
SELECT s.model_version, CASE WHEN s.is_champion THEN 'champion' ELSE s.state END AS state, m.model_family,
       c.execution_mode, NULLIF(d.failed_gates, '') AS reason
FROM lstate s JOIN meta m USING (model_version) JOIN cand c USING (model_version) JOIN decision d USING (model_version)""")
def q_model_listing(spark: SparkSession, sf: str) -> DataFrame:
    states = _states(spark, sf)
    cands = _candidates(spark, sf)
    tags = _metadata(spark, sf).select("model_version", "model_family").join(
        cands.select("model_version", "execution_mode", F.array_join("failed_gates", "|").alias("failed_gates_tag")),
        "model_version").select("*", F.lit(None).cast("string").alias("state_tag"), F.lit(None).cast("string").alias("rejection_reason"))
    return L.model_listing(states, tags)


@register("compare_models", LC + """,
w AS (SELECT model_version, max(value) FILTER (WHERE metric = 'pr_auc') AS pr_auc,
             max(value) FILTER (WHERE metric = 'attack_class_recall') AS attack_class_recall,
             max(value) FILTER (WHERE metric = 'f1') AS f1, max(value) FILTER (WHERE metric = 'false_positive_rate') AS false_positive_rate,
             max(value) FILTER (WHERE metric = 'roc_auc') AS roc_auc FROM version_metrics GROUP BY model_version)
SELECT model_version, round(0.35 * attack_class_recall + 0.25 * f1 + 0.25 * pr_auc + 0.10 * COALESCE(roc_auc, 0.0)
       + 0.05 * (1.0 - false_positive_rate), 6) AS selection_score,
       row_number() OVER (ORDER BY 0.35 * attack_class_recall + 0.25 * f1 + 0.25 * pr_auc + 0.10 * COALESCE(roc_auc, 0.0)
       + 0.05 * (1.0 - false_positive_rate) DESC, model_version) AS comparison_rank
FROM w""")
def q_compare_models(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    w = m.groupBy("model_version").pivot("metric", ["pr_auc", "attack_class_recall", "f1", "false_positive_rate",
                                                     "inference_latency_ms_per_row", "roc_auc"]).agg(F.first("value"))
    s = w.select("model_version", composite_selection_score(F.col("attack_class_recall"), F.col("f1"), F.col("pr_auc"),
                                                            F.col("roc_auc"), F.col("false_positive_rate")).alias("score"))
    from pyspark.sql import Window
    # one row per model version: ranking the comparison table is bounded by the number of models
    ranked = s.withColumn("comparison_rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "model_version")))
    return ranked.select("model_version", _r("score").alias("selection_score"), "comparison_rank")


@register("comparison_rank", LC + """
SELECT metric, model_version, round(value, 6) AS value,
       rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric IN ('false_positive_rate', 'inference_latency_ms_per_row') THEN value ELSE -value END)
         AS comparison_rank
FROM version_metrics""")
def q_comparison_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of each version per metric: error rate and latency ascending, the others descending."""
    from pyspark.sql import Window

    m = _metrics(spark, sf)
    less = F.col("metric").isin("false_positive_rate", "inference_latency_ms_per_row")
    # one row per version and metric
    w = Window.partitionBy("metric").orderBy(F.when(less, F.col("value")).otherwise(-F.col("value")))
    return m.select("metric", "model_version", _r("value").alias("value"), F.rank().over(w).alias("comparison_rank"))


@register("duplicate_registration", O.with_ctes(O.RUNS) + """,
regs AS (SELECT retraining_run_id AS run_id, 'retrain' AS source, CAST(dayofmonth(started_at) AS VARCHAR) AS model_version,
                finished_at AS registered_at FROM retraining_runs
         UNION ALL
         SELECT retraining_run_id, 'retrain', CAST(dayofmonth(started_at) + 100 AS VARCHAR), finished_at + INTERVAL 1 HOUR
         FROM retraining_runs WHERE final_status = 'promotion_pending'),
first AS (SELECT run_id, source, arg_min(model_version, (registered_at, model_version)) AS canonical_version FROM regs GROUP BY ALL)
SELECT r.run_id, r.source, r.model_version, f.canonical_version, r.model_version <> f.canonical_version AS duplicate
FROM regs r JOIN first f USING (run_id, source)""")
def q_duplicate_registration(spark: SparkSession, sf: str) -> DataFrame:
    runs = A.retraining_runs(spark, sf)
    base = runs.select(F.col("retraining_run_id").alias("run_id"), F.lit("retrain").alias("source"),
                       F.dayofmonth("started_at").cast("string").alias("model_version"), F.col("finished_at").alias("registered_at"))
    again = runs.filter(F.col("final_status") == "promotion_pending").select(
        F.col("retraining_run_id").alias("run_id"), F.lit("retrain").alias("source"),
        (F.dayofmonth("started_at") + 100).cast("string").alias("model_version"),
        (F.col("finished_at") + F.expr("INTERVAL 1 HOUR")).alias("registered_at"))
    return L.duplicate_registration(base.unionByName(again))


@register("pending_retry", LC + """,
pend AS (SELECT CAST(dayofmonth(CAST(day AS DATE)) % 3 + 1 AS VARCHAR) AS model_version, CAST(dayofmonth(CAST(day AS DATE)) % 4 AS INTEGER) AS attempts
         FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events) WHERE dayofmonth(CAST(day AS DATE)) % 4 = 3)
SELECT p.model_version, p.attempts, COALESCE(d.decision, 'promotion_pending') AS outcome,
       CASE WHEN d.decision IN ('promoted', 'rejected', 'already_champion') THEN 'resolved'
            WHEN p.attempts + 1 >= 3 THEN 'exhausted' ELSE 'still_pending' END AS retry_status
FROM pend p LEFT JOIN decision d USING (model_version)""")
def q_pending_retry(spark: SparkSession, sf: str) -> DataFrame:
    runs = A.retraining_runs(spark, sf).filter(F.col("final_status") == "promotion_pending")
    dom = F.dayofmonth("started_at")
    pending = runs.select((dom % 3 + 1).cast("string").alias("model_version"), (dom % 4).cast("int").alias("attempts"))
    return L.pending_retry(pending, _decisions(spark, sf), max_attempts=3)


@register("validate_candidate", LC + _META_SQL + """,
man AS (SELECT m.model_version, 'ids' AS model_name, m.source_run_id AS run_id, m.source_model_uri AS model_uri, m.model_family,
               CASE WHEN m.model_version = '2' THEN NULL ELSE 'trial-' || m.model_version END AS source_trial, 3 AS lineage_sections,
               CASE WHEN m.model_version <> '3' THEN v.value END AS test_pr_auc, m.model_version = '2' AS retrained
        FROM meta m JOIN (SELECT model_version, value FROM version_metrics WHERE metric = 'pr_auc') v USING (model_version)),
codes AS (SELECT model_version, list_filter([
    CASE WHEN model_name IS NULL THEN 'missing_model_name' END, CASE WHEN run_id IS NULL THEN 'missing_run_id' END,
    CASE WHEN model_uri IS NULL OR NOT regexp_matches(model_uri, '^(runs|models|file|s3|dbfs):') THEN 'invalid_model_uri' END,
    CASE WHEN model_family IS NULL THEN 'missing_model_family' END,
    CASE WHEN source_trial IS NULL AND NOT retrained THEN 'missing_source_trial' END,
    CASE WHEN lineage_sections < 3 THEN 'incomplete_lineage' END,
    CASE WHEN NOT retrained AND test_pr_auc IS NULL THEN 'missing_test_metrics' END,
    CASE WHEN retrained AND test_pr_auc IS NOT NULL THEN 'unexpected_test_metrics' END], lambda x: x IS NOT NULL) AS errs FROM man)
SELECT model_version, len(errs) = 0 AS valid, array_to_string(errs, '|') AS errors FROM codes""")
def q_validate_candidate(spark: SparkSession, sf: str) -> DataFrame:
    meta = _metadata(spark, sf)
    ap = _metrics(spark, sf).filter(F.col("metric") == "pr_auc").select("model_version", F.col("value").alias("ap"))
    v = F.col("model_version")
    man = meta.join(ap, "model_version").select(
        "model_version", F.lit("ids").alias("model_name"), F.col("source_run_id").alias("run_id"),
        F.col("source_model_uri").alias("model_uri"), "model_family",
        F.when(v != "2", F.concat(F.lit("trial-"), v)).alias("source_trial"), F.lit(3).alias("lineage_sections"),
        F.when(v != "3", F.col("ap")).alias("test_pr_auc"), (v == "2").alias("retrained"))
    r = L.validate_candidate(man, F.col("retrained"))
    return r.select("model_version", "valid", F.array_join("errors", "|").alias("errors"))


@register("version_metrics_cache", O.with_ctes(O.PREDICTIONS) + """,
fp AS (SELECT model_version, sha256(CAST(count(*) AS VARCHAR) || ':' ||
         CAST(sum(('0x' || substr(sha256(prediction_id), 1, 15))::UBIGINT) AS VARCHAR) || ':' ||
         CAST(sum(('0x' || substr(sha256(prediction_id), 16, 15))::UBIGINT) AS VARCHAR)) AS slice_fingerprint
       FROM predictions WHERE ground_truth IS NOT NULL GROUP BY ALL)
SELECT model_version, slice_fingerprint, slice_fingerprint = (SELECT slice_fingerprint FROM fp WHERE model_version = '2') AS cache_hit,
       CASE WHEN slice_fingerprint = (SELECT slice_fingerprint FROM fp WHERE model_version = '2') THEN 'reuse' ELSE 'rescore' END AS action
FROM fp""")
def q_version_metrics_cache(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.operators.monitoring import dataset_fingerprint
    p = A.predictions(spark, sf).filter(F.col("ground_truth").isNotNull())
    fp = materialize(dataset_fingerprint(p, F.col("prediction_id"), ["model_version"]).withColumnRenamed(
        "fingerprint", "slice_fingerprint"))
    current = fp.filter(F.col("model_version") == "2").select(F.col("slice_fingerprint").alias("_cur"))
    j = fp.withColumn("_k", F.lit(1)).join(current.withColumn("_k", F.lit(1)), "_k", "left")
    return L.version_metrics_cache(j, F.col("_cur"))


@register("params_recovery", O.with_ctes(O.PREDICTIONS) + """,
params AS (
  SELECT model_version, 'gbt.max_iter' AS key, CAST(count(*) AS VARCHAR) AS value FROM predictions GROUP BY ALL
  UNION ALL SELECT model_version, 'gbt.learning_rate', CAST(CAST(avg(probability) AS DECIMAL(18,6)) AS VARCHAR) FROM predictions GROUP BY ALL
  UNION ALL SELECT model_version, 'gbt.use_weights', 'true' FROM predictions GROUP BY ALL
  UNION ALL SELECT model_version, 'gbt.note', 'v' || model_version FROM predictions GROUP BY ALL
  UNION ALL SELECT model_version, 'other.max_iter', '1' FROM predictions GROUP BY ALL)
SELECT model_version, regexp_replace(key, '^[^.]+\\.', '') AS param, value,
       CASE WHEN lower(value) IN ('true', 'false') THEN 'bool' WHEN regexp_matches(value, '^[+-]?[0-9]+$') THEN 'int'
            WHEN regexp_matches(value, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float' ELSE 'string' END AS value_type
FROM params WHERE starts_with(key, 'gbt.') AND regexp_replace(key, '^[^.]+\\.', '') IN ('max_iter', 'learning_rate', 'use_weights', 'note')""")
def q_params_recovery(spark: SparkSession, sf: str) -> DataFrame:
    p = A.predictions(spark, sf)
    g = p.groupBy("model_version").agg(F.count(F.lit(1)).cast("string").alias("n"),
                                       F.avg("probability").cast("decimal(18,6)").cast("string").alias("lr"))
    params = g.select("model_version", F.inline(F.array(
        F.struct(F.lit("gbt.max_iter").alias("key"), F.col("n").alias("value")),
        F.struct(F.lit("gbt.learning_rate").alias("key"), F.col("lr").alias("value")),
        F.struct(F.lit("gbt.use_weights").alias("key"), F.lit("true").alias("value")),
        F.struct(F.lit("gbt.note").alias("key"), F.concat(F.lit("v"), F.col("model_version")).alias("value")),
        F.struct(F.lit("other.max_iter").alias("key"), F.lit("1").alias("value")))))
    known = {"max_iter": "int", "learning_rate": "float", "use_weights": "bool", "note": "string"}
    return L.params_recovery(params, "gbt.", known).select("model_version", "param", "value", "value_type")

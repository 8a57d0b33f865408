"""Registered queries: ops roll-ups, KPI gauges, metric registry, request stats, search summaries,
label delivery, scenario reports and scalar helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.functions import class_name, parse_param_type, safe_div, score_to_class, sigmoid_score
from kestrel.operators import ops as OP
from kestrel.operators import simulation as SIM
from kestrel.operators.metrics import labelled_performance, ranking_metrics
from kestrel.plans import adapters as A
from kestrel.plans import oracle as O
from kestrel.plans.registry import register

PRED = O.with_ctes(O.PREDICTIONS)


def _uniform_sql(key: str, seed: int) -> str:
    return f"(CAST({O.seeded_hash_sql(seed, key)} AS DOUBLE) / {float(1 << 60)})"


@register("check_scores", PRED + """
SELECT model_version, count(*) FILTER (WHERE value / 300.0 IS NULL OR isnan(value / 300.0) OR isinf(value / 300.0)
       OR value / 300.0 < 0 OR value / 300.0 > 1) AS rejected, count(*) AS scored FROM predictions GROUP BY ALL""")
def q_check_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = A.predictions(spark, sf).withColumn("raw", F.col("value") / 300.0)
    bad = F.col("raw").isNull() | F.isnan("raw") | (F.abs("raw") == F.lit(float("inf"))) | (F.col("raw") < 0) | (F.col("raw") > 1)
    return p.groupBy("model_version").agg(F.count_if(bad).alias("rejected"), F.count(F.lit(1)).alias("scored"))


@register("sigmoid_score", PRED + """
SELECT prediction_id, round(1.0 / (1.0 + exp(-((value - 100.0) / 50.0))), 9) AS score,
       CASE WHEN 1.0 / (1.0 + exp(-((value - 100.0) / 50.0))) >= 0.5 THEN 'ATTACK' ELSE 'BENIGN' END AS prediction
FROM predictions""")
def q_sigmoid_score(spark: SparkSession, sf: str) -> DataFrame:
    p = A.predictions(spark, sf).withColumn("s", sigmoid_score((F.col("value") - 100.0) / 50.0))
    return p.select("prediction_id", F.round("s", 9).alias("score"), score_to_class("s").alias("prediction"))


@register("score_to_class", PRED + """
SELECT CASE WHEN probability >= 0.5 THEN 'ATTACK' ELSE 'BENIGN' END AS predicted_class,
       CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS predicted_target, count(*) AS rows FROM predictions GROUP BY ALL""")
def q_score_to_class(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.functions import score_to_target
    p = A.predictions(spark, sf)
    return p.groupBy(score_to_class("probability").alias("predicted_class"),
                     score_to_target("probability").alias("predicted_target")).agg(F.count(F.lit(1)).alias("rows"))


@register("class_name", PRED + """
SELECT CASE WHEN CAST(ground_truth AS VARCHAR) IN ('1', 'ATTACK') THEN 'ATTACK' ELSE 'BENIGN' END AS truth_class,
       CASE WHEN prediction IN ('1', 'ATTACK') THEN 'ATTACK' ELSE 'BENIGN' END AS predicted_class, count(*) AS rows
FROM predictions GROUP BY ALL""")
def q_class_name(spark: SparkSession, sf: str) -> DataFrame:
    p = A.predictions(spark, sf)
    return p.groupBy(class_name("ground_truth").alias("truth_class"), class_name("prediction").alias("predicted_class")).agg(
        F.count(F.lit(1)).alias("rows"))


@register("safe_div", PRED + """
SELECT event_type, round(count(*) FILTER (WHERE ground_truth = 1) / NULLIF(count(*) FILTER (WHERE ground_truth = 1 AND value > 1000), 0), 6) AS ratio
FROM predictions GROUP BY ALL""")
def q_safe_div(spark: SparkSession, sf: str) -> DataFrame:
    p = A.predictions(spark, sf)
    g = p.groupBy("event_type").agg(F.count_if(F.col("ground_truth") == 1).alias("a"),
                                    F.count_if((F.col("ground_truth") == 1) & (F.col("value") > 1000)).alias("b"))
    return g.select("event_type", F.round(safe_div(F.col("a"), F.col("b")), 6).alias("ratio"))


@register("parse_param", """
SELECT v AS value, CASE WHEN lower(v) IN ('true', 'false') THEN 'bool' WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN 'int'
       WHEN regexp_matches(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float' ELSE 'string' END AS value_type,
       count(*) AS rows
FROM (SELECT json_extract_string(props, '$.k') AS v FROM events UNION ALL SELECT CAST(value AS VARCHAR) FROM events
      UNION ALL SELECT event_type FROM events) GROUP BY ALL""")
def q_parse_param(spark: SparkSession, sf: str) -> DataFrame:
    ev = A.table(spark, sf, "events")
    vals = (ev.select(F.get_json_object("props", "$.k").alias("v")).unionByName(ev.select(F.col("value").cast("string").alias("v")))
            .unionByName(ev.select(F.col("event_type").alias("v"))))
    return vals.groupBy(F.col("v").alias("value"), parse_param_type("v").alias("value_type")).agg(F.count(F.lit(1)).alias("rows"))


@register("metric_rollup", PRED + """,
ev AS (
  SELECT 'predictions_total' AS name, 'counter' AS kind, 'class=' || prediction || ',version=' || model_version AS labels_key,
         1.0 AS value, "timestamp" AS ts FROM predictions
  UNION ALL SELECT 'predictions_total', 'counter', 'class=' || prediction || ',version=' || model_version, -1.0, "timestamp"
            FROM predictions WHERE event_id % 500 = 7
  UNION ALL SELECT 'latest_probability', 'gauge', 'version=' || model_version,
            CASE WHEN event_id % 997 = 0 THEN 'NaN'::DOUBLE ELSE probability END, "timestamp" FROM predictions
  UNION ALL SELECT 'latency_seconds', 'summary', 'route=' || event_type, value / 1000.0, "timestamp" FROM predictions
)
SELECT name, kind, labels_key,
       round(sum(value) FILTER (WHERE kind = 'counter' AND value >= 0), 6) AS counter_total,
       count(*) FILTER (WHERE kind = 'counter' AND value < 0) AS rejected_increments,
       round(arg_max(CASE WHEN NOT isnan(value) AND NOT isinf(value) THEN value END, ts) FILTER (WHERE kind = 'gauge'), 6) AS gauge_value,
       count(*) FILTER (WHERE kind = 'summary') AS summary_count,
       round(sum(value) FILTER (WHERE kind = 'summary'), 6) AS summary_sum
FROM ev GROUP BY ALL""")
def q_metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    p = A.predictions(spark, sf)
    lab = F.concat(F.lit("class="), F.col("prediction"), F.lit(",version="), F.col("model_version"))
    counters = p.select(F.lit("predictions_total").alias("name"), F.lit("counter").alias("kind"), lab.alias("labels_key"),
                        F.lit(1.0).alias("value"), F.col("timestamp").alias("ts"))
    negative = p.filter(F.col("event_id") % 500 == 7).select(F.lit("predictions_total").alias("name"), F.lit("counter").alias("kind"),
                                                             lab.alias("labels_key"), F.lit(-1.0).alias("value"), F.col("timestamp").alias("ts"))
    gauges = p.select(F.lit("latest_probability").alias("name"), F.lit("gauge").alias("kind"),
                      F.concat(F.lit("version="), F.col("model_version")).alias("labels_key"),
                      F.when(F.col("event_id") % 997 == 0, F.lit(float("nan"))).otherwise(F.col("probability")).alias("value"),
                      F.col("timestamp").alias("ts"))
    summaries = p.select(F.lit("latency_seconds").alias("name"), F.lit("summary").alias("kind"),
                         F.concat(F.lit("route="), F.col("event_type")).alias("labels_key"), (F.col("value") / 1000.0).alias("value"),
                         F.col("timestamp").alias("ts"))
    r = OP.metric_rollup(counters.unionByName(negative).unionByName(gauges).unionByName(summaries))
    return r.select("name", "kind", "labels_key", F.round("counter_total", 6).alias("counter_total"), "rejected_increments",
                    F.round("gauge_value", 6).alias("gauge_value"), "summary_count", F.round("summary_sum", 6).alias("summary_sum"))


@register("request_stats", PRED + """
SELECT time_bucket(INTERVAL 5 MINUTE, "timestamp") AS window_start, event_type AS route, count(*) AS requests,
       round(count(*) / 300.0, 6) AS request_rate, round(CAST(sum(CAST(value / 1000.0 AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS mean_latency_s,
       count(*) FILTER (WHERE event_type = 'error') AS errors_5xx,
       round(count(*) FILTER (WHERE prediction = 'ATTACK') / count(*), 6) AS attack_share
FROM predictions GROUP BY ALL""")
def q_request_stats(spark: SparkSession, sf: str) -> DataFrame:
    p = A.predictions(spark, sf).select(F.col("timestamp").alias("ts"), F.col("event_type").alias("route"),
                                        (F.col("value") / 1000.0).alias("duration_s"),
                                        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), "prediction")
    r = OP.request_stats(p, "5 minutes", ["route"])
    return r.select("window_start", "route", "requests", *[F.round(c, 6).alias(c) for c in ("request_rate", "mean_latency_s")],
                    "errors_5xx", F.round("attack_share", 6).alias("attack_share"))


@register("flatten_metrics", PRED + """,
lp AS (SELECT model_version, count(ground_truth) AS labelled_rows, count(*) FILTER (WHERE ground_truth = 1) AS true_attack,
              count(*) FILTER (WHERE ground_truth = 0) AS true_benign,
              count(*) FILTER (WHERE prediction = 'ATTACK' AND ground_truth = 1) / NULLIF(count(*) FILTER (WHERE ground_truth = 1), 0) AS attack_recall
       FROM predictions GROUP BY ALL)
SELECT model_version, name, round(value, 6) AS value FROM (
  SELECT model_version, 'performance.support.labelled_rows' AS name, CAST(labelled_rows AS DOUBLE) AS value FROM lp
  UNION ALL SELECT model_version, 'performance.support.true_attack', CAST(true_attack AS DOUBLE) FROM lp
  UNION ALL SELECT model_version, 'performance.support.true_benign', CAST(true_benign AS DOUBLE) FROM lp
  UNION ALL SELECT model_version, 'performance.attack_recall', attack_recall FROM lp
  UNION ALL SELECT model_version, 'performance.available', CASE WHEN labelled_rows >= 20 THEN 1.0 ELSE 0.0 END FROM lp)""")
def q_flatten_metrics(spark: SparkSession, sf: str) -> DataFrame:
    perf = labelled_performance(A.predictions(spark, sf), by=["model_version"])
    nested = perf.select("model_version", F.struct(
        F.struct("labelled_rows", "true_attack", "true_benign").alias("support"), "attack_recall",
        (F.col("status") == "available").alias("available"), F.col("status").alias("status_text")).alias("performance"))
    flat = OP.flatten_metrics(nested, ["model_version"])
    return flat.select("model_version", "name", F.round("value", 6).alias("value"))


def _retraining_sql(state: str, has_run: str = "true") -> str:
    return (f"CASE WHEN COALESCE({state}, 'idle') = 'idle' AND NOT {has_run} THEN 'no_data' "
            f"WHEN COALESCE({state}, 'idle') IN ('idle', 'cooldown') THEN COALESCE({state}, 'idle') ELSE 'active' END")


_HEALTHY_SQL = "('healthy', 'available', 'unchanged', 'inactive', 'no_data')"


@register("status_rollup_expr", O.with_ctes(O.RUNS) + """,
comp AS (SELECT strftime(started_at, '%Y-%m-%d') AS day, dayofmonth(started_at) AS d,
                CASE dayofmonth(started_at) % 7 WHEN 0 THEN 'unhealthy' WHEN 1 THEN 'warming_up' WHEN 2 THEN 'stale' WHEN 3 THEN ''
                     ELSE 'healthy' END AS health,
                CASE final_status WHEN 'failed' THEN 'cooldown' WHEN 'rejected' THEN 'idle' ELSE final_status END AS state,
                CASE dayofmonth(started_at) % 5 WHEN 0 THEN 'unhealthy' WHEN 1 THEN NULL ELSE 'available' END AS resilience
         FROM retraining_runs),
n AS (SELECT day, health, CASE health WHEN 'unhealthy' THEN 'degraded' WHEN '' THEN 'no_data' ELSE health END AS monitoring_status,
             """ + _retraining_sql("state", "(d % 2 = 0)") + """ AS retraining_status,
             CASE resilience WHEN 'unhealthy' THEN 'degraded' WHEN 'available' THEN CASE WHEN d % 3 > 0 THEN 'healthy' ELSE 'inactive' END
                  ELSE 'no_data' END AS resilience_status FROM comp)
SELECT day, monitoring_status, retraining_status, resilience_status,
       CASE WHEN monitoring_status IN """ + _HEALTHY_SQL + """ AND retraining_status IN """ + _HEALTHY_SQL + """
                 AND resilience_status IN """ + _HEALTHY_SQL + """ THEN 'healthy' ELSE 'degraded' END AS overall_status,
       CASE health WHEN 'healthy' THEN 1.0 WHEN 'warming_up' THEN 0.5 ELSE 0.0 END AS health_gauge
FROM n""")
def q_status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """A day's three components from its retraining run, and health words by the day of the month."""
    runs = A.retraining_runs(spark, sf)
    d = F.dayofmonth("started_at")
    pick = lambda n, words, other: F.coalesce(F.try_element_at(F.create_map(*[x for k, v in words.items() for x in (
        F.lit(k), F.lit(v))]), d % n), F.lit(other))
    health = pick(7, {0: "unhealthy", 1: "warming_up", 2: "stale", 3: ""}, "healthy")
    state = (F.when(F.col("final_status") == "failed", F.lit("cooldown")).when(F.col("final_status") == "rejected", F.lit("idle"))
             .otherwise(F.col("final_status")))
    ms = OP.monitoring_status(health, F.lit(None))
    rs = OP.retraining_status(F.lit(True), state, d % 2 == 0)
    ss = OP.resilience_status(F.when(d % 5 == 1, F.lit(None)).otherwise(pick(5, {0: "unhealthy"}, "available")), d % 3)
    return runs.select(F.date_format("started_at", "yyyy-MM-dd").alias("day"), ms.alias("monitoring_status"),
                       rs.alias("retraining_status"), ss.alias("resilience_status"), OP.overall_status([ms, rs, ss]).alias("overall_status"),
                       OP.health_gauge(health).alias("health_gauge"))


@register("ops_overview", O.with_ctes(O.PREDICTIONS, O.RUNS) + """,
last_run AS (SELECT * FROM retraining_runs ORDER BY started_at DESC LIMIT 1),
cur AS (SELECT count(*) FILTER (WHERE prediction = 'ATTACK') / count(*) AS attack_share, count(*) AS predictions,
               max("timestamp") AS last_prediction_at FROM predictions),
prob AS (SELECT count(*) AS active FROM (SELECT DISTINCT CAST(strftime("timestamp", '%Y-%m-%d') AS TIMESTAMP) + INTERVAL 6 HOUR AS began
                                         FROM predictions), cur
         WHERE began <= last_prediction_at AND began + INTERVAL 1 DAY > last_prediction_at),
s AS (SELECT r.*, c.*, CASE WHEN predictions < 50 THEN 'warming_up' ELSE 'healthy' END AS monitoring_status,
             """ + _retraining_sql("r.final_status") + """ AS retraining_status,
             CASE WHEN active > 0 THEN 'healthy' ELSE 'inactive' END AS resilience_status FROM last_run r, cur c, prob)
SELECT retraining_run_id AS latest_event, final_status AS retraining_state, monitoring_status, retraining_status, resilience_status,
       CASE WHEN monitoring_status IN """ + _HEALTHY_SQL + """ AND retraining_status IN """ + _HEALTHY_SQL + """
                 AND resilience_status IN """ + _HEALTHY_SQL + """ THEN 'healthy' ELSE 'degraded' END AS overall_status,
       round(attack_share, 6) AS attack_share, predictions, last_prediction_at FROM s""")
def q_ops_overview(spark: SparkSession, sf: str) -> DataFrame:
    """The latest run, the current predictions and the three components, one row."""
    runs = A.retraining_runs(spark, sf)
    last = runs.agg(F.max_by(F.struct("retraining_run_id", "final_status"), "started_at").alias("l")).select("l.*")
    p = A.predictions(spark, sf)
    cur = p.agg((F.count_if(F.col("prediction") == "ATTACK") / F.count(F.lit(1))).alias("attack_share"),
                F.count(F.lit(1)).alias("predictions"), F.max("timestamp").alias("last_prediction_at"))
    one = last.withColumn("_k", F.lit(1)).join(cur.withColumn("_k", F.lit(1)), "_k")
    starts = A.promotions(spark, sf).select("promoted_at", F.lit(1).alias("_k"))
    running = F.count_if((F.col("promoted_at") <= F.col("last_prediction_at"))
                         & (F.col("promoted_at") + F.expr("INTERVAL 1 DAY") > F.col("last_prediction_at")))
    active = starts.join(one.select("_k", "last_prediction_at"), "_k").groupBy("_k").agg(running.alias("active"))
    j = one.join(active, "_k", "left")
    ms = OP.monitoring_status(F.when(F.col("predictions") < 50, F.lit("warming_up")).otherwise(F.lit("healthy")), F.lit(None))
    rs = OP.retraining_status(F.lit(True), F.col("final_status"), F.lit(True))
    ss = OP.resilience_status(F.lit("available"), F.col("active"))
    return j.select(F.col("retraining_run_id").alias("latest_event"), F.col("final_status").alias("retraining_state"),
                    ms.alias("monitoring_status"), rs.alias("retraining_status"), ss.alias("resilience_status"),
                    OP.overall_status([ms, rs, ss]).alias("overall_status"),
                    F.round("attack_share", 6).alias("attack_share"), "predictions", "last_prediction_at")


_GAUGES = ("monitoring_health", "window_rows", "monitored_feature_count", "drifting_feature_count", "drift_share", "labelled_rows",
           "attack_recall", "precision", "f1", "false_positive_rate", "accuracy", "attack_share", "attack_count", "benign_count")
_FLAGS = ("data_drift_detected", "performance_available", "cooldown_active", "promotion_pending")
_STATES = {"status": ("ok", "warming_up"), "retraining_result": ("failed", "promoted", "rejected", "promotion_pending")}


def _kpi_sql() -> str:
    from kestrel.plans.q_monitor import daily_sql

    rows = [f"SELECT report_day, model_version, '{g}' AS gauge, CAST({g} AS DOUBLE) AS value FROM k" for g in _GAUGES]
    rows += [f"SELECT report_day, model_version, '{g}', CASE WHEN {g} THEN 1.0 ELSE 0.0 END FROM k" for g in _FLAGS]
    rows += [f"SELECT report_day, model_version, '{c}_{s}', CASE WHEN {c} = '{s}' THEN 1.0 ELSE 0.0 END FROM k"
             for c, states in _STATES.items() for s in states]
    return f"""
WITH rep AS ({daily_sql()}),
runs AS (SELECT strftime(ts, '%Y-%m-%d') AS report_day, count(*) AS n FROM events GROUP BY ALL),
k AS (SELECT rep.*, CASE status WHEN 'warming_up' THEN 0.5 ELSE 1.0 END AS monitoring_health,
             performance_status = 'available' AS performance_available,
             CASE dayofmonth(CAST(report_day AS DATE)) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'promoted' WHEN 2 THEN 'rejected'
                  ELSE 'promotion_pending' END AS retraining_result,
             dayofmonth(CAST(report_day AS DATE)) % 4 = 3 AS promotion_pending, n >= 7200 AS cooldown_active
      FROM rep JOIN runs USING (report_day))
SELECT report_day, model_version, gauge, round(value, 6) AS value FROM ({" UNION ALL ".join(rows)}) WHERE value IS NOT NULL"""


@register("kpi_row", _kpi_sql())
def q_kpi_row(spark: SparkSession, sf: str) -> DataFrame:
    """Gauges of the daily monitoring reports and of the day's retraining run; the cooldown counts as
    active where the run ended two hours or more after its start."""
    from kestrel.plans.q_monitor import daily_reports

    runs = A.retraining_runs(spark, sf).select(
        F.date_format("started_at", "yyyy-MM-dd").alias("report_day"), F.col("final_status").alias("retraining_result"),
        (F.col("finished_at") >= F.col("started_at") + F.expr("INTERVAL 2 HOURS")).alias("cooldown_active"),
        (F.col("final_status") == "promotion_pending").alias("promotion_pending"))
    r = daily_reports(spark, sf).join(runs, "report_day").withColumns({
        "monitoring_health": OP.health_gauge(F.when(F.col("status") == "ok", F.lit("healthy")).otherwise(F.col("status"))),
        "performance_available": F.col("performance_status") == "available"})
    k = OP.kpi_row(r, ["report_day", "model_version"], _GAUGES, _FLAGS, _STATES)
    return k.select("report_day", "model_version", "gauge", F.round("value", 6).alias("value"))


# ---- search summaries over trial tables derived from the labelled log -----------------------------
_TRIALS_SQL = O.with_ctes(O.PREDICTIONS, O.LABEL_EVENTS) + """,
tf AS (SELECT prediction_id, arg_min(label, (arrival, seq)) AS gt FROM label_events GROUP BY prediction_id),
te AS (SELECT p.model_version AS family, CAST(e.user_id % 5 AS INTEGER) AS trial, f.gt AS target, p.probability AS score
       FROM predictions p JOIN tf f USING (prediction_id) JOIN events e ON e.event_id = p.event_id),
tsc AS (SELECT family, trial, score, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target = 0) AS neg
        FROM te GROUP BY ALL),
tcum AS (SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp FROM tsc
         WINDOW w AS (PARTITION BY family, trial ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
trials AS (SELECT family, trial, sum(pos * ctp / (ctp + cfp)) / sum(pos) AS value,
                  CASE WHEN family = '3' AND trial = 4 THEN 'FAIL' WHEN sum(pos * ctp / (ctp + cfp)) / sum(pos) < 0.38 THEN 'PRUNED'
                       ELSE 'COMPLETE' END AS state FROM tcum GROUP BY family, trial)"""


def _trials(spark, sf):
    ev = A.version_eval(spark, sf).join(A.table(spark, sf, "events").select(
        F.concat(F.lit("pred-"), F.col("event_id").cast("string")).alias("prediction_id"), "user_id"), "prediction_id")
    t = ev.select(F.col("model_version").alias("family"), (F.col("user_id") % 5).cast("int").alias("trial"), "target", "score")
    r = ranking_metrics(t, "target", "score", ["family", "trial"])
    state = (F.when((F.col("family") == "3") & (F.col("trial") == 4), F.lit("FAIL"))
             .when(F.col("average_precision") < 0.38, F.lit("PRUNED")).otherwise(F.lit("COMPLETE")))
    return r.select("family", "trial", F.col("average_precision").alias("value"), state.alias("state"))


@register("trial_state_counts", _TRIALS_SQL + """
SELECT family, count(*) FILTER (WHERE state = 'COMPLETE') AS COMPLETE, count(*) FILTER (WHERE state = 'PRUNED') AS PRUNED,
       count(*) FILTER (WHERE state = 'FAIL') AS FAIL FROM trials GROUP BY family""")
def q_trial_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = _trials(spark, sf)
    pv = t.groupBy("family").pivot("state", ["COMPLETE", "PRUNED", "FAIL"]).agg(F.count(F.lit(1)))
    return pv.select("family", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("COMPLETE", "PRUNED", "FAIL")])


@register("best_trial", _TRIALS_SQL + """
SELECT family, trial, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY value DESC, trial) AS rn FROM trials WHERE state = 'COMPLETE') WHERE rn = 1""")
def q_best_trial(spark: SparkSession, sf: str) -> DataFrame:
    t = _trials(spark, sf).filter(F.col("state") == "COMPLETE")
    best = t.groupBy("family").agg(F.min_by(F.struct("trial", "value"), F.struct((-F.col("value")).alias("v"), "trial")).alias("b"))
    return best.select("family", "b.trial", F.round("b.value", 6).alias("value"))


@register("search_summary", _TRIALS_SQL + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY value DESC, trial) AS rn FROM trials
                        WHERE state = 'COMPLETE') WHERE rn = 1)
SELECT family, trial AS best_trial, round(value, 6) AS best_value, row_number() OVER (ORDER BY value DESC, family) AS family_rank,
       row_number() OVER (ORDER BY value DESC, family) = 1 AS winner FROM best""")
def q_search_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = _trials(spark, sf).filter(F.col("state") == "COMPLETE")
    best = t.groupBy("family").agg(F.min_by(F.struct("trial", "value"), F.struct((-F.col("value")).alias("v"), "trial")).alias("b"))
    # one row per model family: ranking the family table is bounded by the number of families
    w = Window.orderBy(F.col("b.value").desc(), "family")
    return best.select("family", F.col("b.trial").alias("best_trial"), F.round("b.value", 6).alias("best_value"),
                       F.row_number().over(w).alias("family_rank"), (F.row_number().over(w) == 1).alias("winner"))


@register("importance_rank", O.with_ctes(O.RAW_FLOWS) + """,
imp AS (SELECT 'line_number' AS feature, 1 AS position, corr(line_number, target) AS importance FROM processed WHERE source_partition = 'train'
        UNION ALL SELECT 'quantity', 2, corr(quantity, target) FROM processed WHERE source_partition = 'train'
        UNION ALL SELECT 'discount', 3, corr(discount, target) FROM processed WHERE source_partition = 'train'
        UNION ALL SELECT 'tax', 4, corr(tax, target) FROM processed WHERE source_partition = 'train')
SELECT feature, round(importance, 9) AS importance, row_number() OVER (ORDER BY abs(importance) DESC, position) AS rank FROM imp""")
def q_importance_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = A.flows_processed(spark, sf).filter(F.col("source_partition") == "train")
    wide = p.agg(*[F.corr(c, F.col("target").cast("double")).alias(c) for c in A.FLOW_FEATURES])
    tall = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i + 1).alias("position"),
                                                   F.col(c).alias("importance")) for i, c in enumerate(A.FLOW_FEATURES)])))
    # one row per feature: the ranking window is bounded by the feature count
    w = Window.orderBy(F.abs("importance").desc(), "position")
    return tall.select("feature", F.round("importance", 9).alias("importance"), F.row_number().over(w).alias("rank"))


# ---- simulated label delivery ---------------------------------------------------------------------
SIM_NOW = "2024-01-30 12:00:00"


def _delays(spark, sf):
    return SIM.label_delay(A.predictions(spark, sf), seed=42, min_delay=0.1, max_delay=1.0, failure_rate=0.3,
                           max_attempts=3, now=F.lit(SIM_NOW).cast("timestamp_ntz"))


_DELAY_SQL = PRED + """,
d0 AS (SELECT *, 0.1 + (1.0 - 0.1) * """ + _uniform_sql("prediction_id", 42) + """ AS delay_seconds,
              """ + _uniform_sql("prediction_id || '#0'", 42) + """ < 0.3 AS f0,
              """ + _uniform_sql("prediction_id || '#1'", 42) + """ < 0.3 AS f1,
              """ + _uniform_sql("prediction_id || '#2'", 42) + """ < 0.3 AS f2 FROM predictions),
d1 AS (SELECT *, CASE WHEN NOT f0 THEN 1 WHEN NOT f1 THEN 2 WHEN NOT f2 THEN 3 END AS att FROM d0),
delays AS (SELECT *, COALESCE(att, 3) AS attempts,
                  "timestamp" + to_microseconds(CAST(floor(delay_seconds * COALESCE(att, 3) * 1e6) AS BIGINT)) AS label_arrival,
                  CASE WHEN att IS NULL THEN 'failed'
                       WHEN "timestamp" + to_microseconds(CAST(floor(delay_seconds * COALESCE(att, 3) * 1e6) AS BIGINT))
                            > TIMESTAMP '""" + SIM_NOW + """' THEN 'pending' ELSE 'delivered' END AS label_outcome FROM d1)"""


@register("label_delay", _DELAY_SQL + """
SELECT prediction_id, round(delay_seconds, 9) AS delay_seconds, attempts, label_arrival, label_outcome FROM delays""")
def q_label_delay(spark: SparkSession, sf: str) -> DataFrame:
    d = _delays(spark, sf)
    return d.select("prediction_id", F.round("delay_seconds", 9).alias("delay_seconds"), "attempts", "label_arrival",
                    "label_outcome")


@register("label_batches", O.with_ctes(O.PREDICTIONS, O.LABEL_EVENTS) + """,
pend AS (SELECT prediction_id, seq, arrival, row_number() OVER (ORDER BY arrival, prediction_id, seq) - 1 AS i FROM label_events),
b AS (SELECT *, CAST(floor(i / 10) AS BIGINT) AS batch_no FROM pend)
SELECT prediction_id, seq, batch_no, count(*) OVER (PARTITION BY batch_no) AS batch_rows,
       count(*) OVER (PARTITION BY batch_no) = 10 AS complete FROM b""")
def q_label_batches(spark: SparkSession, sf: str) -> DataFrame:
    le = A.label_events(spark, sf).withColumn(
        "_t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', arrival)"))
    b = SIM.label_batches(le, "_t", 10, drain=True, tiebreak=["prediction_id", "seq"])
    return b.select("prediction_id", "seq", F.col("batch_no").cast("bigint").alias("batch_no"), "batch_rows", "complete")


@register("scenario_report", _DELAY_SQL + """
SELECT count(*) AS attempted, count(*) FILTER (WHERE validation_category = 'valid') AS succeeded,
       count(*) FILTER (WHERE validation_category <> 'valid') AS failed,
       count(*) FILTER (WHERE prediction = 'ATTACK') AS predicted_attack, count(*) FILTER (WHERE prediction = 'BENIGN') AS predicted_benign,
       count(DISTINCT model_version) AS model_versions,
       count(*) FILTER (WHERE label_outcome = 'delivered') AS labels_delivered, count(*) FILTER (WHERE label_outcome = 'pending') AS labels_pending,
       count(*) FILTER (WHERE label_outcome = 'failed') AS labels_failed,
       sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(('0x' || substr(sha256(prediction_id), 1, 15))::UBIGINT) AS VARCHAR) || ':'
              || CAST(sum(('0x' || substr(sha256(prediction_id), 16, 15))::UBIGINT) AS VARCHAR)) AS run_fingerprint
FROM (SELECT *, """ + O.validate_sql("features") + """ FROM delays)""")
def q_scenario_report(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.operators.serving import validate_features
    d = validate_features(_delays(spark, sf), "features", A.PAYLOAD_FIELDS).withColumn(
        "request_status", F.when(F.col("validation_category") == "valid", F.lit("ok")).otherwise(F.lit("rejected")))
    return SIM.scenario_report(d)


@register("lineage_row", PRED + """
SELECT model_version, count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || ':' ||
         CAST(sum(('0x' || substr(sha256(prediction_id), 1, 15))::UBIGINT) AS VARCHAR) || ':' ||
         CAST(sum(('0x' || substr(sha256(prediction_id), 16, 15))::UBIGINT) AS VARCHAR)) AS data_fingerprint,
       sha256('k|value') AS schema_fingerprint, sha256('seed=42;threshold=0.5') AS config_fingerprint,
       sha256('family=gbt;version=' || model_version) AS params_fingerprint
FROM predictions GROUP BY model_version""")
def q_lineage_row(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.operators.monitoring import dataset_fingerprint
    p = A.predictions(spark, sf)
    fp = dataset_fingerprint(p, F.col("prediction_id"), ["model_version"]).withColumnRenamed("fingerprint", "data_fingerprint")
    models = p.select("model_version").distinct().withColumn("params_text", F.concat(F.lit("family=gbt;version="), F.col("model_version")))
    r = SIM.lineage_row(models, fp, "k|value", "seed=42;threshold=0.5")
    return r.select("model_version", "rows", "data_fingerprint", "schema_fingerprint", "config_fingerprint", "params_fingerprint")

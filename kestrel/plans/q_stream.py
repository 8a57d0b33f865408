"""Registered queries: Structured Streaming jobs drained with ``availableNow`` over files derived
from the driver's tables (written under the shared checkpoint folder)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import written
from kestrel.operators import ml as ML
from kestrel.operators import probation as PB
from kestrel.plans import adapters as A
from kestrel.plans import oracle as O
from kestrel.plans.registry import register
from kestrel.session import ensure_checkpoint_dir
from kestrel.streaming import jobs as J
from kestrel.streaming import keyed as K
from kestrel.streaming import served as SV


def _ws(spark: SparkSession, name: str) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/streams/{name}-{uuid.uuid4().hex[:12]}"


def _write_source(df: DataFrame, path: str) -> None:
    """Event-time columns become TIMESTAMP (watermarks need it); values are UTC wall-clock."""
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    df.write.mode("append").parquet(path)


def _source_schema(spark: SparkSession, path: str):
    return spark.read.parquet(path).schema


def _log_rows(spark: SparkSession, sf: str) -> DataFrame:
    return A.predictions(spark, sf).drop("ground_truth", "ground_truth_received_at")


def _deliveries(df: DataFrame, column: str) -> list[DataFrame]:
    """The table as two deliveries, what happened before SPLIT_TS first."""
    split = F.lit(A.SPLIT_TS).cast("timestamp_ntz")
    return [df.where(F.col(column) < split), df.where(F.col(column) >= split)]


END = dt.datetime(2100, 1, 1)


@register("stream_log", O.with_ctes(O.PREDICTIONS) + "\nSELECT prediction_id, \"timestamp\" FROM predictions")
def q_stream_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two deliveries, the second with the first one's early rows again (a client retry)."""
    ws = _ws(spark, "log")
    rows = _log_rows(spark, sf)
    again = rows.where(F.col("timestamp") < F.lit("2024-01-11 00:00:00").cast("timestamp_ntz"))
    first, second = _deliveries(rows, "timestamp")
    for part in ([first], [second, again]):
        for p in part:
            _write_source(p, f"{ws}/src")
        J.stream_log(spark, f"{ws}/src", _source_schema(spark, f"{ws}/src"), f"{ws}/log", f"{ws}/ckpt")
    return spark.read.parquet(f"{ws}/log").select("prediction_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


SCORE_FIELDS = list(A.PAYLOAD_FIELDS)


def version_models(spark: SparkSession, log: DataFrame, base: str) -> dict[str, str]:
    """A logistic pipeline per model version, fitted on all its labelled, valid predictions, saved."""
    known = log.where(F.col("ground_truth").isNotNull() & F.col("value").isNotNull())
    rows = known.select("model_version", F.col("ground_truth").cast("int").alias("target"), *SCORE_FIELDS)
    folders = {}
    for version in ("1", "2", "3"):
        folders[version] = f"{base}/model-{version}"
        model = ML.fit_logistic(rows.where(F.col("model_version") == version), SCORE_FIELDS, max_iter=50)
        ML.save_model(model, folders[version], SCORE_FIELDS)
    return folders


@register("stream_score", O.with_ctes(O.PREDICTIONS) + f""",
v AS (SELECT prediction_id, model_version, {O.validate_sql("features")} FROM predictions)
SELECT prediction_id, model_version, validation_category, validation_category = 'valid' AS scored_as_in_batch FROM v""")
def q_stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """Every record once; ``scored_as_in_batch``: it has a score, and score and class are those of
    ``score_table`` with the same saved model. Rejected records have none."""
    ws = _ws(spark, "score")
    # every fit and the batch scores read the typed log: payloads are parsed once for all of them
    typed = written(A.monitored_predictions(spark, sf).select("prediction_id", "model_version", "ground_truth", *SCORE_FIELDS), "typed-log")
    models = version_models(spark, typed, ws)
    for part in _deliveries(_log_rows(spark, sf), "timestamp"):
        _write_source(part, f"{ws}/src")
        SV.stream_score(spark, f"{ws}/src", _source_schema(spark, f"{ws}/src"), "features", SCORE_FIELDS, models,
                        f"{ws}/out", f"{ws}/ckpt")
    out = spark.read.parquet(f"{ws}/out")
    log = typed.where(F.col("value").isNotNull() & F.col("k").isNotNull())
    batch = None
    for version, folder in models.items():
        rows = log.where(F.col("model_version") == version).select(F.col("prediction_id").alias("source_id"), *SCORE_FIELDS)
        s = ML.score_table(PipelineModel.load(folder), rows, "source_id", version, F.lit(None).cast("timestamp"))
        s = s.select(F.col("source_id").alias("prediction_id"), F.col("score").alias("b_score"), F.col("prediction").alias("b_class"))
        batch = s if batch is None else batch.unionByName(s)
    same = F.col("score").eqNullSafe(F.col("b_score")) & F.col("prediction").eqNullSafe(F.col("b_class")) & F.col("score").isNotNull()
    return out.join(batch, "prediction_id", "left").select("prediction_id", "model_version", "validation_category",
                                                           same.alias("scored_as_in_batch"))


@register("stream_label_join", O.with_ctes(O.PREDICTIONS, O.LABEL_EVENTS) + """,
firsts AS (SELECT prediction_id, arg_min(label, (arrival, seq)) AS first_label, min((arrival, seq)) AS f
           FROM label_events GROUP BY prediction_id)
SELECT l.prediction_id, l.label, l.arrival, l.seq, l.batch_id,
       CASE WHEN p.prediction_id IS NULL THEN 'unknown' WHEN (l.arrival, l.seq) = f.f THEN 'recorded'
            WHEN l.label = f.first_label THEN 'idempotent' ELSE 'conflict' END AS status,
       CASE WHEN p.prediction_id IS NULL THEN 'dead_letter' ELSE 'merged' END AS route
FROM label_events l LEFT JOIN firsts f USING (prediction_id) LEFT JOIN predictions p USING (prediction_id)""")
def q_stream_label_join(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and predictions in two deliveries, a restart between them, and a heartbeat at the end."""
    ws = _ws(spark, "labels")
    preds, labels = _deliveries(_log_rows(spark, sf), "timestamp"), _deliveries(A.label_events(spark, sf), "arrival")
    K.heartbeat(spark, f"{ws}/beats")

    def drain():
        K.stream_label_join(spark, f"{ws}/labels", _source_schema(spark, f"{ws}/labels"), f"{ws}/preds",
                            _source_schema(spark, f"{ws}/preds"), f"{ws}/out", f"{ws}/ckpt", f"{ws}/beats")

    for p, le in zip(preds, labels):
        _write_source(p, f"{ws}/preds")
        _write_source(le, f"{ws}/labels")
        drain()
    K.heartbeat(spark, f"{ws}/beats", END)
    drain()
    return K.read_labels(spark, f"{ws}/out").drop("batch").withColumn("arrival", F.col("arrival").cast("timestamp_ntz"))


@register("stream_rates", O.with_ctes(O.PREDICTIONS) + """
SELECT time_bucket(INTERVAL 5 MINUTE, "timestamp") AS window_start, event_type AS route, count(*) AS requests,
       round(count(*) / 300.0, 6) AS request_rate, round(CAST(sum(CAST(value / 1000.0 AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS mean_latency_s,
       count(*) FILTER (WHERE event_type = 'error') AS errors_5xx,
       round(count(*) FILTER (WHERE prediction = 'ATTACK') / count(*), 6) AS attack_share
FROM predictions GROUP BY ALL""")
def q_stream_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Three deliveries: the later half, the earlier half (all late by then) and a heartbeat."""
    ws = _ws(spark, "rates")
    req = A.predictions(spark, sf).select(F.col("timestamp").alias("ts"), F.col("event_type").alias("route"),
                                          (F.col("value") / 1000.0).alias("duration_s"),
                                          F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
                                          "prediction")
    K.heartbeat(spark, f"{ws}/beats")
    for part in reversed(_deliveries(req, "ts")):
        _write_source(part, f"{ws}/src")
        K.stream_rates(spark, f"{ws}/src", _source_schema(spark, f"{ws}/src"), f"{ws}/out", f"{ws}/ckpt", f"{ws}/beats")
    K.heartbeat(spark, f"{ws}/beats", END)
    K.stream_rates(spark, f"{ws}/src", _source_schema(spark, f"{ws}/src"), f"{ws}/out", f"{ws}/ckpt", f"{ws}/beats")
    r = K.read_rates(spark, f"{ws}/out")
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "route", "requests", F.round("request_rate", 6).alias("request_rate"),
                    F.round("mean_latency_s", 6).alias("mean_latency_s"), "errors_5xx",
                    F.round("attack_share", 6).alias("attack_share"))


@register("stream_drain", O.with_ctes(O.QUEUE_LINES) + """
SELECT count(*) FILTER (WHERE line_status = 'valid') AS attempted,
       count(DISTINCT CASE WHEN line_status = 'valid' THEN json_extract_string(try_cast(value AS JSON), '$.prediction_id') END) AS persisted,
       count(*) FILTER (WHERE line_status = 'malformed') AS malformed, count(*) FILTER (WHERE line_status = 'blank') AS blank
FROM queue_scan""")
def q_stream_drain(spark: SparkSession, sf: str) -> DataFrame:
    ws = _ws(spark, "drain")
    q = A.queue_lines(spark, sf)
    q.select("value").write.mode("overwrite").text(f"{ws}/queue")
    J.stream_drain(spark, f"{ws}/queue", f"{ws}/log", f"{ws}/archive", f"{ws}/report", f"{ws}/ckpt")
    r = spark.read.parquet(f"{ws}/report")
    return r.agg(F.sum("attempted").cast("bigint").alias("attempted"), F.sum("persisted").cast("bigint").alias("persisted"),
                 F.sum("malformed").cast("bigint").alias("malformed"), F.sum("blank").cast("bigint").alias("blank"))


def _monitor_sql() -> str:
    """Three epochs: the first delivery, the second, and early rows again, which leave the window as it is."""
    from kestrel.plans.q_monitor import _report_sql

    def at(where: str) -> str:
        return "SELECT * FROM (" + _report_sql(
            f"""win AS (SELECT * FROM monitored {where} ORDER BY "timestamp" DESC, prediction_id DESC LIMIT 500)""", "", "") + ")"

    first, second = at(f"WHERE \"timestamp\" < TIMESTAMP '{A.SPLIT_TS}'"), at("")
    columns = "window_rows, status, drift_share, drifting_features, performance_status, labelled_rows, attack_recall, f1"
    return f"""
SELECT CAST(0 AS BIGINT) AS epoch, 'computed' AS action, CAST(0 AS BIGINT) AS report_epoch, {columns} FROM ({first})
UNION ALL SELECT 1, 'computed', 1, {columns} FROM ({second})
UNION ALL SELECT 2, 'skipped_unchanged_input', 1, {columns} FROM ({second})"""


@register("stream_monitor", _monitor_sql())
def q_stream_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """A report per delivery, restarted between them; the third delivery changes nothing in the window."""
    from kestrel.plans.q_monitor import CFG, _report_out

    ws = _ws(spark, "monitor")
    log = A.monitored_predictions(spark, sf)
    early = log.where(F.col("timestamp") < F.lit(A.REFERENCE_END).cast("timestamp_ntz"))
    reference = A.monitoring_reference(spark, sf)
    for part in (*_deliveries(log, "timestamp"), early):
        _write_source(part, f"{ws}/src")
        SV.stream_monitor(spark, f"{ws}/src", _source_schema(spark, f"{ws}/src"), reference, A.MONITOR_FEATURES, CFG, ws, f"{ws}/ckpt")
    r = _report_out(SV.read_ledger(spark, ws), [])
    return r.select("epoch", "action", "report_epoch", "window_rows", "status", "drift_share", "drifting_features",
                    "performance_status", "labelled_rows", "attack_recall", "f1")


def _probation_sql() -> str:
    from kestrel.plans.q_probation import PSQL

    return PSQL + "\nSELECT probation_id, probation_status, labelled_rows FROM pstatus"


@register("stream_probation", _probation_sql())
def q_stream_probation(spark: SparkSession, sf: str) -> DataFrame:
    """Running probation evidence in two deliveries: each keeps the rows inside a probation's window, and
    judges every probation on what came so far. Both tables lie under their epoch, which a repeat
    overwrites."""
    from kestrel.plans.q_probation import PCFG, PNOW

    ws = _ws(spark, "probation")
    probations = PB.start_probation(A.promotions(spark, sf), PCFG)

    def handler(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
        PB.probation_window(probations, rows).write.mode("overwrite").parquet(f"{ws}/window/epoch={epoch}")
        seen = spark.read.parquet(f"{ws}/window").where(F.col("epoch") <= epoch).drop("epoch")
        st = PB.probation_status(probations, seen, PCFG, F.lit(PNOW).cast("timestamp_ntz"))
        st.select("probation_id", "probation_status", "labelled_rows").write.mode("overwrite").parquet(f"{ws}/status/epoch={epoch}")

    for part in _deliveries(A.probation_observations(spark, sf), "timestamp"):
        _write_source(part, f"{ws}/src")
        J.stream_each_batch(spark, f"{ws}/src", _source_schema(spark, f"{ws}/src"), f"{ws}/ckpt", handler, max_files=1000)
    s = spark.read.parquet(f"{ws}/status")
    return s.groupBy("probation_id").agg(F.max_by(F.struct("probation_status", "labelled_rows"), "epoch").alias("v")).select(
        "probation_id", "v.probation_status", "v.labelled_rows")

"""Registered queries: record validation, late labels, idempotent appends, the JSONL queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import serving as S
from kestrel.plans import adapters as A
from kestrel.plans import oracle as O
from kestrel.plans.registry import register

PRED = O.with_ctes(O.PREDICTIONS)


def _validated(spark, sf):
    return S.validate_features(A.predictions(spark, sf), "features", A.PAYLOAD_FIELDS)


def _joined(c):
    return F.array_join(c, "|")


@register("validate_features", PRED + f"""
SELECT prediction_id, {O.validate_sql("features")} FROM predictions""")
def q_validate_features(spark: SparkSession, sf: str) -> DataFrame:
    v = _validated(spark, sf)
    return v.select("prediction_id", "validation_category", _joined("missing_fields").alias("missing_fields"),
                    _joined("unexpected_fields").alias("unexpected_fields"), _joined("invalid_fields").alias("invalid_fields"))


@register("rejection_log", PRED + f""",
v AS (SELECT prediction_id, {O.validate_sql("features")} FROM predictions)
SELECT * FROM v WHERE validation_category <> 'valid'""")
def q_rejection_log(spark: SparkSession, sf: str) -> DataFrame:
    return S.rejection_log(_validated(spark, sf))


@register("validate_batch", O.with_ctes(O.PREDICTIONS.replace("event_type,", "event_type, user_id,")) + f""",
v AS (SELECT user_id AS batch_id, event_id, {O.validate_sql("features")} FROM predictions)
SELECT batch_id, count(*) AS batch_size, count(*) FILTER (WHERE validation_category <> 'valid') AS invalid_rows,
       array_to_string(list_sort(list(CAST(event_id AS VARCHAR)) FILTER (WHERE validation_category <> 'valid')), '|') AS bad_indexes,
       CASE WHEN count(*) > 64 THEN 'batch_too_large' WHEN count(*) FILTER (WHERE validation_category <> 'valid') > 0
            THEN 'batch_validation_failed' ELSE 'accepted' END AS batch_status
FROM v GROUP BY batch_id""")
def q_validate_batch(spark: SparkSession, sf: str) -> DataFrame:
    ev = A.table(spark, sf, "events").select("event_id", "user_id")
    v = _validated(spark, sf).join(ev, "event_id").withColumnRenamed("user_id", "batch_id")
    b = S.validate_batch(v, "batch_id", "event_id", 64)
    return b.select("batch_id", "batch_size", "invalid_rows",
                    F.array_join(F.array_sort(F.transform("bad_indexes", lambda x: x.cast("string"))), "|").alias("bad_indexes"),
                    "batch_status")


@register("decode_payload", PRED + f""",
v AS (SELECT prediction_id, features, {O.validate_sql("features")} FROM predictions)
SELECT prediction_id, CAST(json_extract(try_cast(features AS JSON), '$.value') AS DOUBLE) AS f_value,
       CAST(json_extract(try_cast(features AS JSON), '$.k') AS DOUBLE) AS f_k
FROM v WHERE validation_category = 'valid'""")
def q_decode_payload(spark: SparkSession, sf: str) -> DataFrame:
    p = A.predictions(spark, sf)
    v = S.validate_features(S.decode_payload(p, "features", A.PAYLOAD_FIELDS), "features", A.PAYLOAD_FIELDS)
    return v.filter(F.col("validation_category") == "valid").select("prediction_id", "f_value", "f_k")


LABELS = O.with_ctes(O.PREDICTIONS, O.LABEL_EVENTS)


@register("merge_labels", LABELS + """,
firsts AS (SELECT prediction_id, arg_min(label, (arrival, seq)) AS first_label, min((arrival, seq)) AS f
           FROM label_events GROUP BY prediction_id)
SELECT l.prediction_id, l.label, l.arrival, l.seq, l.batch_id,
       CASE WHEN p.prediction_id IS NULL THEN 'unknown' WHEN (l.arrival, l.seq) = f.f THEN 'recorded'
            WHEN l.label = f.first_label THEN 'idempotent' ELSE 'conflict' END AS status,
       p.prediction_id IS NULL AS retryable
FROM label_events l LEFT JOIN firsts f USING (prediction_id) LEFT JOIN predictions p USING (prediction_id)""")
def q_merge_labels(spark: SparkSession, sf: str) -> DataFrame:
    return S.merge_labels(A.label_events(spark, sf), A.predictions(spark, sf))


@register("join_labels", LABELS + """,
firsts AS (SELECT prediction_id, arg_min(label, (arrival, seq)) AS ground_truth, min(arrival) AS ground_truth_received_at
           FROM label_events GROUP BY prediction_id)
SELECT p.prediction_id, p.model_version, p.prediction, round(p.probability, 6) AS probability,
       CAST(f.ground_truth AS DOUBLE) AS ground_truth, f.ground_truth_received_at
FROM predictions p LEFT JOIN firsts f USING (prediction_id)""")
def q_join_labels(spark: SparkSession, sf: str) -> DataFrame:
    v = S.labelled_view(A.predictions(spark, sf), A.label_events(spark, sf))
    return v.select("prediction_id", "model_version", "prediction", F.round("probability", 6).alias("probability"),
                    F.col("ground_truth").cast("double").alias("ground_truth"), "ground_truth_received_at")


@register("batch_labels", LABELS + """,
per AS (SELECT batch_id, prediction_id, count(DISTINCT label) AS n FROM label_events GROUP BY ALL)
SELECT batch_id, count(*) AS distinct_ids, count(*) FILTER (WHERE n > 1) AS conflicting_ids,
       count(*) FILTER (WHERE p.prediction_id IS NULL) AS unknown_ids,
       CASE WHEN count(*) FILTER (WHERE n > 1) = 0 AND count(*) FILTER (WHERE p.prediction_id IS NULL) = 0 THEN 'applied'
            WHEN count(*) FILTER (WHERE n > 1) > 0 THEN 'conflict' ELSE 'unknown' END AS batch_status
FROM per LEFT JOIN predictions p USING (prediction_id) GROUP BY batch_id""")
def q_batch_labels(spark: SparkSession, sf: str) -> DataFrame:
    return S.batch_label_verdict(A.label_events(spark, sf), A.predictions(spark, sf))


@register("validate_observation", LABELS + f""",
firsts AS (SELECT prediction_id, arg_min(label, (arrival, seq)) AS gt FROM label_events GROUP BY prediction_id),
obs AS (SELECT p.prediction_id, p.model_version, f.gt, {O.validate_sql("p.features")}
        FROM predictions p JOIN firsts f USING (prediction_id)),
codes AS (SELECT *, list_filter([
            CASE WHEN prediction_id IS NULL OR prediction_id = '' THEN 'missing_prediction_id' END,
            CASE WHEN NOT COALESCE(gt IN (0, 1), false) THEN 'invalid_ground_truth' END,
            CASE WHEN validation_category IN ('malformed_json', 'invalid_record') THEN 'missing_feature_payload' END,
            CASE WHEN validation_category IN ('schema_mismatch', 'invalid_value') THEN 'feature_schema_validation_failed' END,
            CASE WHEN model_version IS NULL OR model_version = '' THEN 'missing_source_model_version' END],
            lambda c: c IS NOT NULL) AS errs FROM obs)
SELECT prediction_id, CASE WHEN len(errs) = 0 THEN 'approved' ELSE 'rejected' END AS validation_status,
       array_to_string(errs, '|') AS validation_errors FROM codes""")
def q_validate_observation(spark: SparkSession, sf: str) -> DataFrame:
    v = S.labelled_view(A.predictions(spark, sf), A.label_events(spark, sf)).filter(F.col("ground_truth").isNotNull())
    o = S.validate_observation(S.validate_features(v, "features", A.PAYLOAD_FIELDS))
    return o.select("prediction_id", "validation_status", F.array_join("validation_errors", "|").alias("validation_errors"))


@register("insert_if_absent", O.with_ctes(O.REPLAY) + """,
firsts AS (SELECT prediction_id, arg_min(ts, attempt) AS ts, min(attempt) AS attempt, arg_min(latency_ms, attempt) AS latency_ms
           FROM replay_batch GROUP BY prediction_id)
SELECT * FROM firsts WHERE prediction_id NOT IN (SELECT prediction_id FROM stored_log)""")
def q_insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    return S.insert_if_absent(A.stored_log(spark, sf), A.replay_batch(spark, sf), "prediction_id", ["attempt"])


@register("scan_jsonl_queue", O.with_ctes(O.QUEUE_LINES) + """
SELECT line_no, line_status, CASE WHEN line_status = 'valid' THEN json_extract_string(try_cast(value AS JSON), '$.prediction_id') END
       AS prediction_id FROM queue_scan""")
def q_scan_jsonl_queue(spark: SparkSession, sf: str) -> DataFrame:
    return S.scan_jsonl_queue(A.queue_lines(spark, sf)).select("line_no", "line_status", "prediction_id")


@register("drain_queue", O.with_ctes(O.QUEUE_LINES, O.REPLAY) + """,
valid AS (SELECT DISTINCT json_extract_string(try_cast(value AS JSON), '$.prediction_id') AS prediction_id FROM queue_scan
          WHERE line_status = 'valid')
SELECT count(*) FILTER (WHERE line_status = 'valid') AS attempted,
       (SELECT count(*) FROM valid WHERE prediction_id NOT IN (SELECT prediction_id FROM stored_log)) AS persisted,
       CAST(0 AS BIGINT) AS remaining, count(*) FILTER (WHERE line_status = 'malformed') AS malformed,
       count(*) FILTER (WHERE line_status = 'blank') AS blank
FROM queue_scan""")
def q_drain_queue(spark: SparkSession, sf: str) -> DataFrame:
    q = S.scan_jsonl_queue(A.queue_lines(spark, sf))
    return S.drain_queue(q, A.stored_log(spark, sf))

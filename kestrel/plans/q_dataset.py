"""Registered queries: retraining dataset assembly (dedup across sources, union, guards)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import written
from kestrel.operators import retrain as RT
from kestrel.operators import validate as V
from kestrel.plans import adapters as A
from kestrel.plans import oracle as O
from kestrel.plans.registry import register

FL = O.with_ctes(O.RAW_FLOWS)
_F32 = "CAST(line_number AS FLOAT) AS k1, CAST(quantity AS FLOAT) AS k2, CAST(discount AS FLOAT) AS k3, CAST(tax AS FLOAT) AS k4, CAST(target AS INTEGER) AS kt"
_DEDUP_SQL = FL + """,
hist AS (SELECT * FROM processed WHERE source_partition = 'train'),
prod AS (SELECT *, """ + _F32 + """ FROM processed WHERE source_partition = 'validation'),
hk AS (SELECT DISTINCT """ + _F32 + """ FROM hist),
fresh AS (SELECT p.* FROM prod p WHERE NOT EXISTS (SELECT 1 FROM hk h WHERE h.k1 = p.k1 AND h.k2 = p.k2 AND h.k3 = p.k3
          AND h.k4 = p.k4 AND h.kt = p.kt)),
dedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k1, k2, k3, k4, kt ORDER BY source_row_number, source_file, row_digest) AS rn
          FROM fresh) WHERE rn = 1)"""


def _split(spark, sf):
    p = A.flows_processed(spark, sf)
    hist = p.filter(F.col("source_partition") == "train")
    prod = p.filter(F.col("source_partition") == "validation")
    return hist, prod


def _dedup(spark, sf):
    hist, prod = _split(spark, sf)
    digests = RT.history_digests(hist, A.FLOW_FEATURES, "target")
    return RT.cross_source_dedup(digests, prod, A.FLOW_FEATURES, "target", ["source_row_number", "source_file", "row_digest"])


@register("cross_source_dedup", _DEDUP_SQL + "\nSELECT row_digest, source_row_number FROM dedup")
def q_cross_source_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _dedup(spark, sf).select("row_digest", "source_row_number")


@register("union_training", _DEDUP_SQL + """
SELECT data_source, CAST(target AS INTEGER) AS target, count(*) AS rows FROM (
  SELECT 'historical' AS data_source, target FROM hist UNION ALL SELECT 'production', target FROM dedup) GROUP BY ALL""")
def q_union_training(spark: SparkSession, sf: str) -> DataFrame:
    hist, _ = _split(spark, sf)
    u = RT.union_training(hist.withColumn("data_source", F.lit("historical")),
                          _dedup(spark, sf).withColumn("data_source", F.lit("production")))
    return u.groupBy("data_source", F.col("target").cast("int").alias("target")).agg(F.count(F.lit(1)).alias("rows"))


HISTORY_ROWS = 1000
SCHEMA = "k|value"

_SET_SQL = O.with_ctes(O.PREDICTIONS, O.MONITORED, O.LABEL_EVENTS, O.RUNS, O.OBSERVATIONS) + f""",
consumed_ok AS (SELECT DISTINCT c.prediction_id FROM consumed c LEFT JOIN retraining_runs r USING (retraining_run_id)
                WHERE r.final_status IS NULL OR r.final_status <> 'failed'),
hist AS (SELECT prediction_id AS row_id, ground_truth AS target, CAST(value AS FLOAT) AS value, CAST(k AS FLOAT) AS k FROM monitored
         WHERE "timestamp" < TIMESTAMP '{A.REFERENCE_END}' AND ground_truth IS NOT NULL AND value IS NOT NULL),
cnt AS (SELECT count(*) FILTER (WHERE target = 0) AS c0, count(*) FILTER (WHERE target = 1) AS c1 FROM hist),
a AS (SELECT *, greatest(1, least(c0, CAST(floor({HISTORY_ROWS} * (c0 / (c0 + c1))) AS BIGINT))) AS a0,
             greatest(1, least(c1, CAST(floor({HISTORY_ROWS} * (c1 / (c0 + c1))) AS BIGINT))) AS a1 FROM cnt),
b AS (SELECT *, greatest({HISTORY_ROWS} - a0 - a1, 0) AS d, abs((c0 - a0) - (c1 - a1)) AS gap, (c0 - a0) >= (c1 - a1) AS to0 FROM a),
q AS (SELECT a0 + CASE WHEN to0 THEN least(d, gap) ELSE 0 END + CAST(ceil((d - least(d, gap)) / 2) AS BIGINT) AS q0,
             a1 + CASE WHEN to0 THEN 0 ELSE least(d, gap) END + CAST(floor((d - least(d, gap)) / 2) AS BIGINT) AS q1 FROM b),
sampled AS (SELECT h.* FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {O.seeded_hash_sql(42, "row_id")}, row_id) AS rn
            FROM hist) h, q WHERE h.rn <= CASE WHEN h.target = 0 THEN q.q0 ELSE q.q1 END),
prod AS (SELECT prediction_id AS row_id, staged_at, ground_truth AS target, CAST(value AS FLOAT) AS value, CAST(k AS FLOAT) AS k
         FROM observations WHERE validation_status = 'approved' AND prediction_id NOT IN (SELECT prediction_id FROM consumed_ok)),
fresh AS (SELECT * FROM prod p WHERE NOT EXISTS (SELECT 1 FROM sampled s WHERE s.value = p.value AND s.k = p.k AND s.target = p.target)
          QUALIFY row_number() OVER (PARTITION BY value, k, target ORDER BY staged_at, row_id) = 1),
final AS (SELECT 'historical' AS data_source, row_id, target, value, k FROM sampled
          UNION ALL SELECT 'production', row_id, target, value, k FROM fresh)"""


def retraining_set(spark: SparkSession, sf: str) -> RT.RetrainingSet:
    """Train history: the first week's labelled, valid predictions. Production: approved observations that
    no run but a failed one consumed (some of them are history rows too: those go)."""
    from kestrel.plans.q_retrain import _runs

    log = A.monitored_predictions(spark, sf)
    history = log.where((F.col("timestamp") < F.lit(A.REFERENCE_END).cast("timestamp_ntz")) & F.col("ground_truth").isNotNull()
                        & F.col("value").isNotNull())
    # the sample reads the history four times, the assembly the observations twice: payloads are parsed once for each
    history = written(history.select("prediction_id", "ground_truth", *A.MONITOR_FEATURES), "retraining-history")
    kept = A.kept_observations(spark, sf)
    consumed = RT.consumed_ids(A.consumed_observations(spark, sf, kept), _runs(spark, sf))
    observed = kept.withColumn("schema_fingerprint", F.lit(SCHEMA))
    return RT.retraining_dataset(history, observed, consumed, A.MONITOR_FEATURES, "ground_truth", SCHEMA, HISTORY_ROWS, 42,
                                 "prediction_id")


@register("retraining_dataset", _SET_SQL + """
SELECT data_source, row_id, CAST(target AS INTEGER) AS target, CAST(value AS DOUBLE) AS value, CAST(k AS DOUBLE) AS k FROM final""")
def q_retraining_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return retraining_set(spark, sf).rows.select("data_source", "row_id", "target", F.col("value").cast("double").alias("value"),
                                                 F.col("k").cast("double").alias("k"))


_ROW_SQL = "CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR) || '|' || CAST(CAST(k AS DECIMAL(18,4)) AS VARCHAR) || '|' || CAST(target AS VARCHAR)"


@register("retraining_manifest", _SET_SQL + f"""
SELECT (SELECT count(*) FROM hist) AS history_before_sampling, count(*) FILTER (WHERE data_source = 'historical') AS historical_rows,
       (SELECT count(*) FROM prod) AS production_available, count(*) FILTER (WHERE data_source = 'production') AS production_rows,
       (SELECT count(*) FROM prod) - count(*) FILTER (WHERE data_source = 'production') AS duplicates_removed,
       count(*) FILTER (WHERE target = 0) AS benign_rows, count(*) FILTER (WHERE target = 1) AS attack_rows,
       42 AS sampling_seed, 'k|value' AS schema_fingerprint,
       sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(('0x' || substr(sha256({_ROW_SQL}), 1, 15))::UBIGINT) AS VARCHAR) || ':'
              || CAST(sum(('0x' || substr(sha256({_ROW_SQL}), 16, 15))::UBIGINT) AS VARCHAR)) AS fingerprint
FROM final""")
def q_retraining_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return retraining_set(spark, sf).manifest


@register("no_test_source", FL + """
SELECT source_partition, count(*) AS rows FROM processed WHERE source_partition IN ('reference', 'train') GROUP BY ALL""")
def q_no_test_source(spark: SparkSession, sf: str) -> DataFrame:
    p = A.flows_processed(spark, sf).filter(F.col("source_partition").isin("reference", "train"))
    guarded = V.no_test_source(p, path=f"{sf}/reference.parquet")
    return guarded.groupBy("source_partition").agg(F.count(F.lit(1)).alias("rows"))


@register("schema_fingerprint_check", O.with_ctes(O.PREDICTIONS, O.LABEL_EVENTS, O.RUNS, O.OBSERVATIONS) + """
SELECT event_id % 11 <> 0 AS schema_matches, count(*) AS rows FROM observations GROUP BY ALL""")
def q_schema_fingerprint_check(spark: SparkSession, sf: str) -> DataFrame:
    current = "k|value"
    o = A.observations(spark, sf).withColumn(
        "schema_fingerprint", F.when(F.col("event_id") % 11 == 0, F.lit("k|value|extra")).otherwise(F.lit(current)))
    c = V.schema_fingerprint_check(o, current)
    return c.groupBy("schema_matches").agg(F.count(F.lit(1)).alias("rows"))

"""Simulated label delivery and scenario run reports as table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.monitoring import position_index
from kestrel.operators.sampling import HASH_SPACE, seeded_hash


def uniform(key: Column, seed: int) -> Column:
    """Seeded uniform [0, 1) from a key (60-bit SHA-256 prefix): identical in every engine."""
    return seeded_hash(key, seed).cast("double") / F.lit(HASH_SPACE)


def label_delay(preds: DataFrame, seed: int, min_delay: float, max_delay: float, failure_rate: float,
                max_attempts: int, now: Column, ts: str = "timestamp", key: str = "prediction_id") -> DataFrame:
    """Arrival = prediction time + seeded uniform delay; each attempt fails with ``failure_rate``
    (seeded per attempt); delivered on the first success within ``max_attempts`` (one delay per
    attempt), failed when all attempts fail, pending when the arrival is after ``now``."""
    delay = F.lit(min_delay) + (max_delay - min_delay) * uniform(F.col(key), seed)
    fails = [uniform(F.concat(F.col(key), F.lit(f"#{i}")), seed) < failure_rate for i in range(max_attempts)]
    attempts = F.lit(None).cast("int")
    for i in reversed(range(max_attempts)):  # first successful attempt
        attempts = F.when(~fails[i], F.lit(i + 1)).otherwise(attempts)
    micros = F.floor(delay * F.coalesce(attempts, F.lit(max_attempts)) * 1e6)
    arrival = F.col(ts) + F.make_dt_interval(secs=(micros / 1e6).cast("decimal(18,6)"))
    outcome = (F.when(attempts.isNull(), F.lit("failed")).when(arrival > now.cast("timestamp_ntz"), F.lit("pending"))
               .otherwise(F.lit("delivered")))
    return preds.select("*", delay.alias("delay_seconds"), F.coalesce(attempts, F.lit(max_attempts)).alias("attempts"),
                        arrival.alias("label_arrival"), outcome.alias("label_outcome"))


def label_batches(pending: DataFrame, order_col: str, batch_size: int, drain: bool,
                  tiebreak: Sequence[str] = ()) -> DataFrame:
    """Pending labels cut into batches of ``batch_size`` in arrival order (exact ranks without a
    single-partition window); an incomplete tail batch is released only when draining."""
    idx = position_index(pending, order_col, "_i", tiebreak)
    b = idx.withColumn("batch_no", F.floor(F.col("_i") / batch_size))
    sizes = b.groupBy("batch_no").agg(F.count(F.lit(1)).alias("batch_rows"))
    out = b.join(sizes, "batch_no").withColumn("complete", F.col("batch_rows") == batch_size)
    if not drain:
        out = out.filter(F.col("complete"))
    return out.drop("_i")


def scenario_report(run: DataFrame) -> DataFrame:
    """Counts attempted / succeeded / failed, class and version mixes, label outcomes and a run fingerprint."""
    from kestrel.operators.monitoring import digest_parts

    a, b = digest_parts(F.col("prediction_id"))
    agg = run.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("request_status") == "ok").alias("succeeded"),
        F.count_if(F.col("request_status") != "ok").alias("failed"),
        F.count_if(F.col("prediction") == "ATTACK").alias("predicted_attack"),
        F.count_if(F.col("prediction") == "BENIGN").alias("predicted_benign"),
        F.count_distinct("model_version").alias("model_versions"),
        F.count_if(F.col("label_outcome") == "delivered").alias("labels_delivered"),
        F.count_if(F.col("label_outcome") == "pending").alias("labels_pending"),
        F.count_if(F.col("label_outcome") == "failed").alias("labels_failed"),
        F.sum(a).alias("_s1"), F.sum(b).alias("_s2"))
    fp = F.sha2(F.concat_ws(":", F.col("attempted").cast("string"), F.col("_s1").cast("string"), F.col("_s2").cast("string")), 256)
    return agg.select(*[c for c in agg.columns if not c.startswith("_")], fp.alias("run_fingerprint"))


def lineage_row(models: DataFrame, data_fp: DataFrame, schema_text: str, config_text: str,
                key: Sequence[str] = ("model_version",)) -> DataFrame:
    """Fingerprints of data, schema, config and parameters attached to each model row."""
    j = models.join(data_fp, list(key), "left")
    return j.select("*", F.sha2(F.lit(schema_text), 256).alias("schema_fingerprint"),
                    F.sha2(F.lit(config_text), 256).alias("config_fingerprint"),
                    F.sha2(F.col("params_text"), 256).alias("params_fingerprint"))

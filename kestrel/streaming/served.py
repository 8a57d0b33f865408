"""Streaming jobs on top of fitted models and reports: scoring, and the monitoring cycle with its ledger."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kestrel.contracts import MonitoringConfig
from kestrel.operators import ml as ML
from kestrel.operators import monitoring as MON
from kestrel.operators import serving as S
from kestrel.streaming.jobs import exists, first_of_batches, run_available, writer_id
from kestrel.streaming.keyed import write_epochs


# ---- scoring --------------------------------------------------------------------------------------
def stream_score(spark: SparkSession, source: str, schema: StructType, payload: str, fields: Sequence[str],
                 models: Mapping[str, str], out_path: str, checkpoint: str, key: str = "prediction_id",
                 order: str = "timestamp", version: str = "model_version", threshold: float = 0.5,
                 max_files: int | None = None) -> list[dict]:
    """Validate arriving records and score the valid ones with the fitted pipeline of their version.

    ``models``: version -> folder of a saved pipeline, loaded once for the query. A record is scored by
    the loaded versions (a few) and keeps its own's score, so the micro-batch is read once. A key seen
    before is not scored again (keyed state). ``route=scored`` has score and class; ``route=rejected``
    has category and field names only, a version that is not loaded among them."""
    read = spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)
    rows = read.schema(schema).parquet(source).mapInArrow(first_of_batches(order, key), schema).dropDuplicates([key])
    checked = S.validate_features(rows.select(key, order, version, payload), payload, fields)
    valid = F.col("validation_category") == "valid"
    known = F.coalesce(F.col(version).isin(list(models)), F.lit(False))
    category = F.when(valid & ~known, F.lit("unknown_model_version")).otherwise(F.col("validation_category"))
    scored = checked.select(
        key, order, version, category.alias("validation_category"),
        *[F.array_join(c, "|").alias(c) for c in ("missing_fields", "unexpected_fields", "invalid_fields")],
        *[F.coalesce(F.col("features_typed")[f], F.lit(0.0)).alias(f) for f in fields])
    score = F.lit(None).cast("double")
    for i, (name, folder) in enumerate(sorted(models.items())):
        scored = ML.positive_score(PipelineModel.load(folder), scored).withColumnRenamed("score", f"_score_{i}")
        score = F.when(F.col(version) == name, F.col(f"_score_{i}")).otherwise(score)
    ok = F.col("validation_category") == "valid"
    bad = ok & ~F.coalesce((score >= 0) & (score <= 1), F.lit(False))
    out = scored.select(
        key, order, version, "validation_category", "missing_fields", "unexpected_fields", "invalid_fields",
        F.when(bad, F.raise_error(F.lit("score out of range"))).when(ok, score).alias("score"),
        F.when(ok, F.when(score >= threshold, F.lit("ATTACK")).otherwise(F.lit("BENIGN"))).alias("prediction"),
        F.when(ok, F.lit("scored")).otherwise(F.lit("rejected")).alias("route"))
    return write_epochs(out, out_path, checkpoint, ["route"])


# ---- monitoring -----------------------------------------------------------------------------------
def window_fingerprint(window: DataFrame) -> str:
    """Identity of the window's rows, labels and probabilities included, whatever their order."""
    text = F.concat_ws("|", "prediction_id", F.coalesce(F.col("ground_truth").cast("string"), F.lit("-")),
                       F.col("probability").cast("decimal(18,6)").cast("string"))
    row = MON.dataset_fingerprint(window.withColumn("_all", F.lit(1)), text, ["_all"]).first()
    return row["fingerprint"] if row else "empty"


def stream_monitor(spark: SparkSession, source: str, schema: StructType, reference_tall: DataFrame, features: Sequence[str],
                   cfg: MonitoringConfig, base: str, checkpoint: str, max_files: int | None = None) -> list[dict]:
    """On every trigger a report over the latest ``cfg.window_size`` predictions, unless that window is
    the one of the last healthy report: then the report is carried over.

    ``base``/window keeps the window of each epoch (the next one is the best of it and the new rows:
    the log is not read again) and ``base``/ledger one row an epoch: fingerprint, action, the epoch
    that made the report, the report. Both are written under the epoch they belong to, so a repeated
    epoch starts from the epoch before it and rewrites its own; a restart finds its state there."""
    me = writer_id(checkpoint)
    place = lambda kind, epoch: f"{base}/{kind}/query={me}/epoch={epoch}"

    def handler(batch: DataFrame, epoch: int) -> None:
        before = place("window", epoch - 1)
        rows = batch
        if exists(spark, before):
            rows = spark.read.schema(batch.schema).parquet(before).unionByName(batch)
        MON.latest_window(rows, cfg.window_size).coalesce(1).write.mode("overwrite").parquet(place("window", epoch))
        window = spark.read.schema(batch.schema).parquet(place("window", epoch))
        mark = window_fingerprint(window)
        last = place("ledger", epoch - 1)
        previous = spark.read.parquet(last) if exists(spark, last) else None
        kept = previous.first() if previous is not None else None
        if kept is not None and kept["health"] == "healthy" and kept["fingerprint"] == mark:
            entry = previous.withColumns({"epoch": F.lit(epoch).cast("long"), "action": F.lit("skipped_unchanged_input"),
                                          "poll_status": F.lit("unchanged")})
        else:
            report = MON.monitoring_report(window, reference_tall, features, cfg)
            entry = report.select(F.lit(epoch).cast("long").alias("epoch"), F.lit(mark).alias("fingerprint"),
                                  F.lit("healthy").alias("health"), F.lit("computed").alias("action"),
                                  F.lit("checked").alias("poll_status"), F.lit(epoch).cast("long").alias("report_epoch"),
                                  *report.columns)
        # one row an epoch
        entry.coalesce(1).write.mode("overwrite").parquet(place("ledger", epoch))

    read = spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)
    stream = read.schema(schema).parquet(source)
    return run_available(stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint))


def read_ledger(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.option("basePath", f"{base}/ledger").parquet(f"{base}/ledger/*/*").drop("query")

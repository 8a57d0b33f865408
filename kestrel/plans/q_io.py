"""Registered queries: file sources and sinks (raw capture scan, partition writes and reads,
manifests, reports), round-tripping data derived from the driver's tables through the shared
checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions import row_digest
from kestrel.plans import adapters as A
from kestrel.plans import oracle as O
from kestrel.plans.registry import register
from kestrel.session import ensure_checkpoint_dir
from kestrel.sources import partitions as P
from kestrel.sources.files import file_manifest, scan_raw_lines


def _ws(spark: SparkSession, name: str) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/io/{name}-{uuid.uuid4().hex[:12]}"


#: Rows that one task sorts and writes, about.
CAPTURE_ROWS = 2_000_000


def write_captures(spark: SparkSession, sf: str, path: str, task_rows: int = CAPTURE_ROWS) -> None:
    """The flows adapter written as CSV-like text, a folder a capture (header line first). A large capture
    lies in several files that follow each other by name: no task sorts more than about ``task_rows``."""
    raw = A.raw_flows(spark, sf)
    header = ",".join(A.FLOW_HEADER)
    files = raw.select("source_file").distinct()
    head = files.select("source_file", F.lit(-1).cast("bigint").alias("ord"), F.lit(header).alias("line"))
    body = raw.select("source_file", F.col("source_row_number").alias("ord"), "line")
    both = head.unionByName(body)
    # a row count of Parquet comes from its footers
    tasks = -(-max(1, A.table(spark, sf, "lineitem").count()) // task_rows)
    (both.repartitionByRange(tasks, "source_file", "ord", "line").sortWithinPartitions("source_file", "ord", "line").select("source_file", "line")
     .write.mode("overwrite").partitionBy("source_file").text(path))


@register("scan_raw_lines", O.with_ctes(O.RAW_FLOWS) + """
SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY source_row_number, line) AS source_row_number,
       sha256(line) AS row_digest FROM raw_flows""")
def q_scan_raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    ws = _ws(spark, "captures")
    write_captures(spark, sf, ws)
    # one capture per directory: the capture name is the partition value of the directory
    lines = scan_raw_lines(spark, f"{ws}/*/*.txt", folders=True)
    capture = F.regexp_extract("source_path", r"source_file=([^/]+)/[^/]+$", 1)
    return lines.select(capture.alias("source_file"), "source_row_number", row_digest("line").alias("row_digest"))


def _written(spark, sf):
    ws = _ws(spark, "partitions")
    P.write_partitions(A.flows_processed(spark, sf), ws)
    return ws


@register("write_partitions", O.with_ctes(O.RAW_FLOWS) + """
SELECT source_partition, count(*) AS rows FROM processed GROUP BY ALL""")
def q_write_partitions(spark: SparkSession, sf: str) -> DataFrame:
    ws = _written(spark, sf)
    return spark.read.parquet(ws).groupBy("source_partition").agg(F.count(F.lit(1)).alias("rows"))


@register("scan_partition", O.with_ctes(O.RAW_FLOWS) + """
SELECT CAST(target AS TINYINT) AS target, count(*) AS rows, round(sum(CAST(quantity AS FLOAT)), 1) AS quantity_sum
FROM processed WHERE source_partition = 'validation' GROUP BY ALL""")
def q_scan_partition(spark: SparkSession, sf: str) -> DataFrame:
    ws = _written(spark, sf)
    v = P.scan_partition(spark, ws, "validation", A.FLOW_FEATURES)
    return v.groupBy("target").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("quantity"), 1).alias("quantity_sum"))


@register("scan_reference", O.with_ctes(O.RAW_FLOWS) + """
SELECT row_digest FROM (SELECT *, row_number() OVER (ORDER BY """ + O.seeded_hash_sql(42, "row_digest") + """, row_digest) AS rn
                        FROM processed WHERE source_partition = 'reference') WHERE rn <= 500""")
def q_scan_reference(spark: SparkSession, sf: str) -> DataFrame:
    ws = _written(spark, sf)
    return P.scan_reference(spark, ws, A.FLOW_FEATURES, 500, 42).select("row_digest")


@register("file_manifest")
def q_file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    ws = _written(spark, sf)
    return file_manifest(spark, f"{ws}/*/*.parquet").select("relative_path", "size_bytes", "sha256")


@register("write_reports", O.with_ctes(O.PREDICTIONS) + """
SELECT model_version, CAST(count(*) AS DOUBLE) AS predictions, NULL::DOUBLE AS mean_probability FROM predictions GROUP BY ALL
UNION ALL SELECT model_version, NULL, round(avg(probability), 6) FROM predictions GROUP BY ALL""")
def q_write_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Ragged report rows (different keys per row kind) aligned, written as JSON and CSV, read back."""
    p = A.predictions(spark, sf)
    a = p.groupBy("model_version").agg(F.count(F.lit(1)).alias("predictions"))
    b = p.groupBy("model_version").agg(F.round(F.avg("probability"), 6).alias("mean_probability"))
    ws = _ws(spark, "reports")
    P.write_reports(P.align_ragged([a, b]), ws)
    back = spark.read.schema("mean_probability double, model_version string, predictions long").json(f"{ws}/json")
    return back.select("model_version", F.col("predictions").cast("double").alias("predictions"), "mean_probability")

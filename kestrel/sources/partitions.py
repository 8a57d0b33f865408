"""Processed-partition sinks and sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.sampling import sample_n
from kestrel.operators.validate import no_test_source


def write_partitions(processed: DataFrame, path: str, part: str = "source_partition",
                     partitions: Sequence[str] = ("train", "validation", "test", "reference")) -> None:
    """Parquet (snappy) partitioned by ``source_partition``; a partition with no rows still gets a
    schema-only file so readers see the contract."""
    (processed.repartition(part).write.mode("overwrite").option("compression", "snappy")
     .partitionBy(part).parquet(path))
    spark = processed.sparkSession
    present = {r[0] for r in spark.read.parquet(path).select(part).distinct().collect()}  # <= 4 names
    for p in partitions:
        if p not in present:
            processed.limit(0).drop(part).write.mode("overwrite").parquet(f"{path}/{part}={p}")


def scan_partition(spark: SparkSession, path: str, partition: str, features: Sequence[str], target: str = "target",
                   part: str = "source_partition") -> DataFrame:
    """Projected read of one partition: target + contract features, cast to float32 / int8
    (column pruning and partition pruning reach the Parquet scan)."""
    df = spark.read.parquet(path).filter(F.col(part) == partition)
    return df.select(F.col(target).cast("tinyint").alias(target), *[F.col(c).cast("float").alias(c) for c in features])


def scan_reference(spark: SparkSession, path: str, features: Sequence[str], sample_size: int | None, seed: int = 42,
                   key: str = "row_digest", part: str = "source_partition") -> DataFrame:
    """Reference read for monitoring: refuses a test path, checks the contract features exist and are
    numeric, then takes a seeded sample."""
    df = spark.read.parquet(path)
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise ValueError(f"reference missing monitored features: {missing}")
    bad = [f.name for f in df.schema.fields if f.name in features and f.dataType.typeName() not in
           ("double", "float", "integer", "long", "short", "byte", "decimal")]
    if bad:
        raise ValueError(f"reference features are not numeric: {bad}")
    ref = no_test_source(df.filter(F.col(part) == "reference"), part, path)
    chosen = ref if sample_size is None else sample_n(ref, sample_size, seed, key)
    return chosen.select(key, *features)


def write_reports(rows: DataFrame, path: str) -> None:
    """Report rows to JSON and CSV; ragged rows are aligned to the sorted union of their keys first."""
    cols = sorted(rows.columns)
    aligned = rows.select(*cols)
    aligned.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    aligned.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def align_ragged(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))

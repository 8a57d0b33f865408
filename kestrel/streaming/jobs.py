"""Streaming jobs. Each job reads a file-source stream, applies the same table operators as
the batch path, and writes through ``foreachBatch`` with idempotent appends so a replay after
a failure (same checkpoint) adds nothing twice. ``trigger(availableNow=True)`` drains what is
there and stops; the same job with a processing-time trigger runs continuously.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kestrel.operators import serving as S


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_if_absent(batch: DataFrame, target_path: str, key: str, order: Sequence[str], epoch: int,
                     writer: str = "w") -> int:
    """Idempotent append of micro-batch ``epoch`` of query ``writer`` into a Parquet table
    partitioned by ``batch = writer-epoch``.

    First row per key inside the batch, only keys absent from other batches; the batch's
    directory is overwritten, so a replayed epoch (restart from the same checkpoint) rewrites
    the same rows instead of adding them again. Returns the number of rows appended.
    """
    spark = batch.sparkSession
    tag = f"{writer}-{epoch}"
    if exists(spark, target_path):
        existing = spark.read.parquet(target_path).filter(F.col("batch") != tag).select(key)
    else:
        existing = spark.createDataFrame([], batch.select(key).schema)
    written = f"{target_path}/batch={tag}"
    S.insert_if_absent(existing, batch, key, order).write.mode("overwrite").parquet(written)
    return spark.read.schema(batch.schema).parquet(written).count()


def writer_id(checkpoint: str) -> str:
    """Stable per-query id: restarts from one checkpoint share it, different queries do not."""
    import hashlib

    return hashlib.sha256(checkpoint.encode()).hexdigest()[:12]


def run_available(stream_writer) -> list[dict]:
    """Run to the end of what is available; such a query ends by itself, so the wait has no limit.
    Returns the progress of its micro-batches."""
    q = stream_writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return list(q.recentProgress)


def first_of_batches(order: str, key: str):
    """The first row per key of each Arrow batch: a hot key crosses the network once a batch."""
    def task(batches):
        import pyarrow as pa

        for batch in batches:
            t = pa.Table.from_batches([batch])
            at = t.append_column("_at", pa.array(range(t.num_rows), pa.int64())).sort_by([(order, "ascending"), ("_at", "ascending")])
            first = at.group_by(key, use_threads=False).aggregate([("_at", "first")])["_at_first"]
            yield from t.take(first).to_batches()

    return task


def stream_log(spark: SparkSession, source: str, schema: StructType, log_path: str, checkpoint: str,
               key: str = "prediction_id", order: str = "timestamp", max_files: int | None = None) -> list[dict]:
    """Exactly-once prediction log: a key is written with the first micro-batch that brings it. The keys
    seen are keyed state, so an epoch looks up its own keys and never reads the log; without a
    watermark no prediction is too late for it. Rows go to day=<event day> under the epoch's folder,
    which a repeated epoch overwrites."""
    from kestrel.streaming.keyed import write_epochs

    read = spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)
    rows = read.schema(schema).parquet(source)
    new = rows.mapInArrow(first_of_batches(order, key), schema).dropDuplicates([key])
    return write_epochs(new.withColumn("day", F.to_date(order)), log_path, checkpoint, ["day"])


def stream_drain(spark: SparkSession, queue_dir: str, log_path: str, archive_path: str, report_path: str,
                 checkpoint: str) -> None:
    """Periodic queue flush: JSONL lines -> valid ids appended idempotently, malformed archived, one
    report row per micro-batch (attempted / persisted / malformed / blank). Each output lies under its
    epoch's folder, which a repeated epoch overwrites."""
    # the line text orders duplicates inside a micro-batch (streams allow no row ids)
    src = spark.readStream.text(queue_dir).withColumn("line_no", F.col("value"))

    def sink(batch: DataFrame, epoch: int) -> None:
        q = S.scan_jsonl_queue(batch)
        tag = f"batch={writer_id(checkpoint)}-{epoch}"
        valid = q.filter(F.col("line_status") == "valid").select("prediction_id", "line_no")
        persisted = append_if_absent(valid, log_path, "prediction_id", ["line_no"], epoch, writer_id(checkpoint))
        q.filter(F.col("line_status") == "malformed").select("value").write.mode("overwrite").text(f"{archive_path}/{tag}")
        rep = q.agg(F.count_if(F.col("line_status") == "valid").alias("attempted"),
                    F.count_if(F.col("line_status") == "malformed").alias("malformed"),
                    F.count_if(F.col("line_status") == "blank").alias("blank")).withColumn(
            "persisted", F.lit(persisted)).withColumn("epoch", F.lit(epoch))
        rep.write.mode("overwrite").parquet(f"{report_path}/{tag}")

    run_available(src.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint))


def stream_each_batch(spark: SparkSession, source: str, schema: StructType, checkpoint: str,
                      handler: Callable[[DataFrame, int], None], max_files: int = 1) -> None:
    """Generic trigger loop (monitoring, probation): run ``handler`` on every micro-batch."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    run_available(src.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint))

"""File-level sources: raw capture lines with exact row numbers, and file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.session import materialize


def scan_raw_lines(spark: SparkSession, paths: str | list[str], drop_header: bool = True, folders: bool = False) -> DataFrame:
    """(source_file, source_row_number, line) from CSV captures, keeping each line's exact text.

    Lines are read in parallel splits. A split's rows are contiguous in its partition, so a
    row's position inside the split is its monotonically increasing id minus the split's
    first id; per-file offsets come from the small table of split counts (one row per split,
    bounded by total bytes / split size) summed in split order. Row 0 of a file is its header.
    With ``folders`` the files of a folder are one capture, in the order of their names: rows are
    numbered through them and the first one has the header.
    """
    raw = spark.read.option("lineSep", "\n").text(paths)
    tagged = raw.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("source_file"),
                        F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mid"),
                        F.when(F.endswith("value", F.lit("\r")), F.left("value", F.length("value") - 1)).otherwise(F.col("value")).alias("line"))
    splits = tagged.groupBy("_path", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    capture = F.regexp_replace("_path", "/[^/]*$", "") if folders else F.col("_path")
    w = Window.partitionBy(capture).orderBy("_path", "_m0").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_path", "_part", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    j = tagged.join(F.broadcast(offsets), ["_path", "_part"])  # one row a split
    pos = F.col("_off") + F.col("_mid") - F.col("_m0")  # 0-based line position in the file
    out = j.select("source_file", F.col("_path").alias("source_path"), pos.alias("_pos"), "line")
    if drop_header:
        out = out.filter(F.col("_pos") > 0)
    return out.select("source_file", "source_path", F.col("_pos").alias("source_row_number"), "line")


#: Files up to this many bytes are hashed whole, larger ones in ranges of this size.
CHUNK_BYTES = 64 << 20


def file_manifest(spark: SparkSession, path_glob: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Path, size, modification time and digest of every file, read by the executors.

    A file of at most ``chunk_bytes`` has the SHA-256 of its content (``ranges`` = 1). A larger one is
    never held whole: its ranges are hashed in tasks of their own (``range_digests``), and its digest
    is the SHA-256 of its size and its ranges' digests, one a line.
    """
    def listed():
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path_glob)

    named = [F.col("path"), F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("relative_path"),
             F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")]
    small = listed().where(F.col("length") <= chunk_bytes).select(
        *named, F.lit(1).cast("long").alias("ranges"), F.sha2("content", 256).alias("sha256"))
    small = small.unionByName(empty_files(spark, listed(), small))
    large = listed().where(F.col("length") > chunk_bytes).select(*named)
    paths = [r["path"] for r in large.select("path").collect()]  # a listing, as the reader itself holds it
    if not paths:
        return small
    ranges = range_digests(spark, paths, chunk_bytes).groupBy("path").agg(
        F.count(F.lit(1)).alias("ranges"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "digest"))), lambda r: r["digest"]), "\n").alias("_d"))
    whole = large.join(ranges, "path").withColumn("sha256", F.sha2(F.concat_ws("\n", F.col("size_bytes").cast("string"), "_d"), 256))
    return small.unionByName(whole.select(*small.columns))


def empty_files(spark: SparkSession, listed: DataFrame, like: DataFrame) -> DataFrame:
    """Manifest rows of the listed files without content, which the binary reader leaves out."""
    # the reader's own listing; local paths come with an empty host there
    names = spark.createDataFrame([("file:/" + p[8:] if p.startswith("file:///") else p,) for p in listed.inputFiles()], "path string")
    found = [r["path"] for r in names.join(listed.select("path"), "path", "left_anti").collect()]
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rows = [(p, fs(p).getFileSystem(conf).getFileStatus(fs(p)).getModificationTime()) for p in found]
    empty = spark.createDataFrame(rows, "path string, ms long")
    return empty.select("path", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("relative_path"),
                        F.lit(0).cast("long").alias("size_bytes"), F.timestamp_millis("ms").alias("modified_at"),
                        F.lit(1).cast("long").alias("ranges"), F.sha2(F.lit(b""), 256).alias("sha256")).select(*like.columns)


def range_digests(spark: SparkSession, paths: list[str], chunk_bytes: int) -> DataFrame:
    """(path, start, digest): SHA-256 of the lines (up to a line feed, whatever the bytes) that begin
    behind ``start`` and not behind ``start + chunk_bytes``, each ended by a line feed; the first range
    has the file's first line too. The ranges are the reader's splits, of one size on any cluster.
    Files that the text reader would unpack by their ending are hashed unpacked."""
    def digest(batches):
        import hashlib

        import pyarrow as pa

        now, h = None, None
        done = lambda: pa.RecordBatch.from_pydict({"path": [now[0]], "start": [now[1]], "digest": [h.hexdigest()]})
        for batch in batches:  # a split's lines follow each other
            for path, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, start) != now:
                    if now:
                        yield done()
                    now, h = (path, start), hashlib.sha256()
                h.update(line)
                h.update(b"\n")
        if now:
            yield done()

    lines = spark.read.option("lineSep", "\n").text(paths).select(
        "_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    splits = {"spark.sql.files.maxPartitionBytes": str(chunk_bytes), "spark.sql.files.minPartitionNum": "1",
              "spark.sql.files.openCostInBytes": str(chunk_bytes)}
    before = {k: spark.conf.get(k, None) for k in splits}
    try:
        for k, v in splits.items():
            spark.conf.set(k, v)
        return materialize(lines.mapInArrow(digest, "path string, start long, digest string"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer comparison of two manifests: added / removed / changed / unchanged."""
    a = before.select("path", F.col("sha256").alias("_a"))
    b = after.select("path", F.col("sha256").alias("_b"))
    j = a.join(b, "path", "full")
    status = (F.when(F.col("_a").isNull(), F.lit("added")).when(F.col("_b").isNull(), F.lit("removed"))
              .when(F.col("_a") != F.col("_b"), F.lit("changed")).otherwise(F.lit("unchanged")))
    return j.select("path", status.alias("status"))

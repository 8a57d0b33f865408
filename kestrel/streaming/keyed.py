"""Streaming jobs with keyed state and timers (``transformWithState`` on the RocksDB store).

Event time drives the timers, but no row is dropped for being late: the rows reach the state without
the watermark column, so the store's late-row filter has nothing to judge. What comes after its timer
has a defined way out instead (a merge against the kept state, or a side table). Time moves with the
data; ``heartbeat`` moves it on when a source falls silent, so that waiting rows come out.

Every micro-batch is written once to ``batch=<query>-<epoch>`` with overwrite: an epoch that is run
again after a failure rewrites its rows.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from kestrel.streaming.jobs import run_available, writer_id

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LABEL, PREDICTION, HEARTBEAT = "label", "prediction", "heartbeat"
HEARTBEAT_SCHEMA = "clock timestamp"


@contextmanager
def state_store(spark: SparkSession):
    """The store that keeps lists and timers; a running query keeps the one it was started with."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def heartbeat(spark: SparkSession, path: str, at: dt.datetime | None = None) -> None:
    """Move the clock of the jobs that read ``path`` to ``at`` (none: only create the source)."""
    rows = [(at,)] if at else []
    spark.createDataFrame(rows, HEARTBEAT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def clocked(rows: DataFrame, beats: str | None, lateness_s: int) -> DataFrame:
    """``rows`` with a ``kind`` and a ``clock`` under one watermark, heartbeats among them."""
    if beats:
        source = rows.sparkSession.readStream.schema(HEARTBEAT_SCHEMA).parquet(beats)
        rows = rows.unionByName(source.select("clock", F.lit(HEARTBEAT).alias("kind")), allowMissingColumns=True)
    return rows.withWatermark("clock", f"{lateness_s} seconds")


def write_epochs(rows: DataFrame, path: str, checkpoint: str, by: list[str]) -> list[dict]:
    """Drain ``rows`` into ``path``/batch=<query>-<epoch>, one write an epoch; the progress of each."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={writer_id(checkpoint)}-{epoch}")

    with state_store(rows.sparkSession):
        return run_available(rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint))


# ---- late labels ------------------------------------------------------------------------------------
MERGED = "prediction_id string, label int, arrival timestamp, seq int, batch_id long, status string"
_MERGED = "prediction_id string, label int, arrival_us long, seq int, batch_id long, status string"


#: Ids share a state by hash: a state is read and written once a micro-batch for all of its ids. The number is
#: part of the checkpoint; at 36 million ids a state holds about 140.
ID_GROUPS = 1 << 18


class LabelMerge(StatefulProcessor):
    """State of a group of prediction ids: for each id when its prediction was last heard of (none: it has not
    come), its first label, and the labels that wait for the prediction. A label comes out once: recorded
    (the first), idempotent (equal to it), conflict (another value, ignored), or unknown when its time
    is up. With ``keep_s`` an id is forgotten that long after its last row; its later labels are unknown.
    One timer a group stands at the earliest of these times."""

    def __init__(self, wait_s: int, keep_s: int | None):
        self.wait_ms, self.keep_ms = wait_s * 1000, keep_s and keep_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # ids as JSON: [id, last_ms, first label, [[label, arrival_us, seq, batch_id], ...]] each
        self.state = handle.getValueState("ids", "ids string, timer long")

    def load(self) -> tuple[dict, int | None]:
        kept = self.state.get()
        return ({e[0]: e[1:] for e in json.loads(kept[0])}, kept[1]) if kept else ({}, None)

    def save(self, ids: dict, timer: int | None) -> None:
        times = [self.due(w) for _, _, waiting in ids.values() for w in waiting]
        if self.keep_ms is not None:
            times += [last + self.keep_ms for last, _, _ in ids.values() if last is not None]
        first = min(times, default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if ids:
            self.state.update((json.dumps([[k, *v] for k, v in ids.items()], separators=(",", ":")), first))
        else:
            self.state.clear()

    def merged(self, key: str | None, entry: list, labels: list) -> Iterator[Row]:
        for label, at, seq, batch in sorted(labels, key=lambda r: (r[1], r[2])):
            if entry[1] is None:
                entry[1], status = label, "recorded"
            else:
                status = "idempotent" if label == entry[1] else "conflict"
            yield Row(prediction_id=key, label=label, arrival_us=at, seq=seq, batch_id=batch, status=status)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict = {}
        for r in rows:  # the rows of the group's ids in one micro-batch
            kind = r.kind
            if kind == HEARTBEAT:
                continue
            got = new.setdefault(r.prediction_id, [[], False, 0])
            got[2] = max(got[2], r.clock_ms)
            if kind == PREDICTION:
                got[1] = True
            else:
                got[0].append([r.label, r.arrival_us, r.seq, r.batch_id])
        if not new:
            return
        ids, timer = self.load()
        for k, (labels, seen, last) in new.items():
            entry = ids.setdefault(k, [None, None, []])
            if not seen and entry[0] is None:
                entry[2] += labels
                continue
            waited, entry[2] = entry[2], []
            if entry[0] is None or (self.keep_ms is not None and last > entry[0]):
                entry[0] = last
            yield from self.merged(k, entry, waited + labels)
        self.save(ids, timer)

    def due(self, label: list) -> int:
        return label[1] // 1000 + self.wait_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ids, timer = self.load()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if timer != now:
            return
        now = max(now, timerValues.getCurrentWatermarkInMs())
        late = []
        for k, entry in list(ids.items()):
            if entry[0] is not None:
                if self.keep_ms is not None and entry[0] + self.keep_ms <= now:
                    del ids[k]
                continue
            late += [(k, w) for w in entry[2] if self.due(w) <= now]
            entry[2] = [w for w in entry[2] if self.due(w) > now]
            if not entry[2]:
                del ids[k]
        self.save(ids, None)      # the timer that fired is gone
        for k, (label, at, seq, batch) in sorted(late, key=lambda x: x[1][1:3]):
            yield Row(prediction_id=k, label=label, arrival_us=at, seq=seq, batch_id=batch, status="unknown")

    def close(self) -> None:
        pass


def stream_label_join(spark: SparkSession, labels_src: str, label_schema: StructType, preds_src: str, pred_schema: StructType,
                      out_path: str, checkpoint: str, beats: str | None = None, wait_s: int = 3600, lateness_s: int = 7200,
                      keep_s: int | None = None, max_files: int | None = None) -> list[dict]:
    """Late labels meet predictions. ``out_path`` gets every label once, under ``route=merged`` with its
    merge status or under ``route=dead_letter`` as unknown, ``wait_s`` of event time after it arrived
    without a prediction; a batch ``merge_labels`` may retry those. The first label of an id is the
    first of the micro-batch that brings one, by (arrival, seq); files are to come in arrival order.
    A label without an id waits like any other. The rows of a group of ids in one micro-batch are held at
    once: ``max_files`` bounds the micro-batch."""
    read = spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)
    labels = read.schema(label_schema).parquet(labels_src).select(
        "prediction_id", F.col("label").cast("int").alias("label"), F.unix_micros("arrival").alias("arrival_us"),
        F.col("seq").cast("int").alias("seq"), F.col("batch_id").cast("long").alias("batch_id"),
        F.lit(LABEL).alias("kind"), F.col("arrival").alias("clock"))
    read = spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)
    preds = read.schema(pred_schema).parquet(preds_src).select(
        "prediction_id", F.lit(PREDICTION).alias("kind"), F.col("timestamp").alias("clock"))
    rows = clocked(labels.unionByName(preds, allowMissingColumns=True), beats, lateness_s)
    keyed = rows.select("prediction_id", "label", "arrival_us", "seq", "batch_id", "kind",
                        F.unix_millis("clock").alias("clock_ms"),
                        F.pmod(F.xxhash64("prediction_id"), F.lit(ID_GROUPS)).alias("id_group")).groupBy("id_group")
    merged = keyed.transformWithState(statefulProcessor=LabelMerge(wait_s, keep_s), outputStructType=_MERGED,
                                      outputMode="Append", timeMode="EventTime")
    routed = merged.select("prediction_id", "label", F.timestamp_micros("arrival_us").alias("arrival"), "seq", "batch_id",
                           "status", F.when(F.col("status") == "unknown", "dead_letter").otherwise("merged").alias("route"))
    return write_epochs(routed, out_path, checkpoint, ["route"])


def read_labels(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.schema(f"{MERGED}, batch string, route string").parquet(out_path)


# ---- request rates ----------------------------------------------------------------------------------
_PARTIAL = "window_us long, route string, requests long, duration_us long, errors_5xx long, attacks long"
RATES = f"{_PARTIAL}"


def _partial_sums(window_s: int):
    """Sums per (window, route) of each Arrow batch: what reaches the state is one row a group."""
    sums = ("requests", "duration_us", "errors_5xx", "attacks")

    def task(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch]).filter(pa.compute.field("kind") != HEARTBEAT)
            us = t["ts_us"]
            floor = pa.compute.floor(pa.compute.divide(us.cast(pa.float64()), float(window_s * 1_000_000))).cast(pa.int64())
            t = t.append_column("window_us", pa.compute.multiply(floor, window_s * 1_000_000))
            g = t.group_by(["window_us", "route"]).aggregate([(c, "sum") for c in sums])
            g = g.select(["window_us", "route", *[f"{c}_sum" for c in sums]]).rename_columns(["window_us", "route", *sums])
            yield from g.to_batches()

    return task


class WindowTotals(StatefulProcessor):
    """State of one (window, route): its sums, until event time passes the window's end; then they come
    out once and the state is freed. Rows for a window that has ended come out as late sums."""

    def __init__(self, window_s: int):
        self.window_ms = window_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "requests long, duration_us long, errors_5xx long, attacks long")

    def row(self, key: tuple, sums: tuple, late: bool) -> Row:
        return Row(window_us=key[0], route=key[1], requests=sums[0], duration_us=sums[1], errors_5xx=sums[2], attacks=sums[3],
                   late=late)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = (0, 0, 0, 0)
        for r in rows:
            new = tuple(a + b for a, b in zip(new, (r.requests, r.duration_us, r.errors_5xx, r.attacks)))
        end = key[0] // 1000 + self.window_ms
        if end <= timerValues.getCurrentWatermarkInMs():
            yield self.row(key, new, True)
        elif self.sums.exists():
            self.sums.update(tuple(a + b for a, b in zip(new, self.sums.get())))
        else:
            self.sums.update(new)
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.sums.exists():
            yield self.row(key, tuple(self.sums.get()), False)
            self.sums.clear()

    def close(self) -> None:
        pass


def stream_rates(spark: SparkSession, source: str, schema: StructType, out_path: str, checkpoint: str,
                 beats: str | None = None, window_s: int = 300, lateness_s: int = 600, max_files: int | None = None) -> list[dict]:
    """Requests, latency, 5xx and class mix per window and route. A window comes out once event time is
    ``lateness_s`` past its end; sums of rows behind that go to the side table (``late=true``) and
    count in ``read_rates`` all the same. State holds open windows only."""
    read = spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)
    requests = read.schema(schema).parquet(source).select(
        F.unix_micros("ts").alias("ts_us"), "route", F.lit(1).cast("long").alias("requests"),
        (F.col("duration_s").cast("decimal(18,6)") * 1_000_000).cast("long").alias("duration_us"),
        (F.col("status") >= 500).cast("long").alias("errors_5xx"), (F.col("prediction") == "ATTACK").cast("long").alias("attacks"),
        F.lit("request").alias("kind"), F.col("ts").alias("clock"))
    sums = clocked(requests, beats, lateness_s).mapInArrow(_partial_sums(window_s), _PARTIAL)
    totals = sums.groupBy("window_us", "route").transformWithState(
        statefulProcessor=WindowTotals(window_s), outputStructType=f"{_PARTIAL}, late boolean", outputMode="Append",
        timeMode="EventTime")
    return write_epochs(totals, out_path, checkpoint, ["late"])


def read_rates(spark: SparkSession, out_path: str, window_s: int = 300) -> DataFrame:
    """The rate table of closed windows, late rows included; ``late_requests`` counts those."""
    rows = spark.read.schema(f"{_PARTIAL}, batch string, late boolean").parquet(out_path)
    sums = rows.groupBy("window_us", "route").agg(
        *[F.sum(c).alias(c) for c in ("requests", "duration_us", "errors_5xx", "attacks")],
        F.sum(F.when(F.col("late"), F.col("requests")).otherwise(0)).alias("late_requests"))
    return sums.select(
        F.timestamp_micros("window_us").alias("window_start"), "route", "requests",
        (F.col("requests") / float(window_s)).alias("request_rate"),
        (F.col("duration_us") / 1_000_000.0 / F.col("requests")).alias("mean_latency_s"), "errors_5xx",
        (F.col("attacks") / F.col("requests")).alias("attack_share"), "late_requests")

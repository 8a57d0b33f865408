"""Streaming jobs: restarts, replays after a failure, waiting and expiring labels, freed state."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kestrel.contracts import MonitoringConfig
from kestrel.operators import ml as ML
from kestrel.streaming import jobs as J
from kestrel.streaming import keyed as K
from kestrel.streaming import served as SV

T0 = dt.datetime(2030, 5, 1)
LABELS = "prediction_id string, label int, arrival timestamp, seq int, batch_id long"
PREDS = "prediction_id string, timestamp timestamp, model_version string"
END = dt.datetime(2040, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


class LabelJob:
    def __init__(self, spark, base, **options):
        self.spark, self.base, self.options = spark, str(base), options
        K.heartbeat(spark, f"{base}/beats")
        self.give([], [])

    def give(self, labels, preds):
        put(self.spark, labels, LABELS, f"{self.base}/labels")
        put(self.spark, preds, PREDS, f"{self.base}/preds")

    def drain(self):
        return K.stream_label_join(
            self.spark, f"{self.base}/labels", self.spark.read.parquet(f"{self.base}/labels").schema, f"{self.base}/preds",
            self.spark.read.parquet(f"{self.base}/preds").schema, f"{self.base}/out", f"{self.base}/ckpt", f"{self.base}/beats",
            **self.options)

    def close(self):
        K.heartbeat(self.spark, f"{self.base}/beats", END)
        return self.drain()

    def out(self):
        return sorted((r["prediction_id"] or "-", r["seq"], r["status"], r["route"])
                      for r in K.read_labels(self.spark, f"{self.base}/out").collect())


def test_every_label_comes_out_once_with_its_status(spark, tmp_path):
    job = LabelJob(spark, tmp_path)
    job.give([("a", 1, at(5), 0, 1), ("a", 1, at(6), 1, 1), ("a", 0, at(7), 2, 1),   # its prediction comes later
              ("ghost", 1, at(5), 3, 1), (None, 0, at(5), 4, 1)], [("b", at(1), "1")])
    job.drain()
    assert job.out() == []
    job.give([("b", 0, at(9), 5, 2), ("b", 0, at(9), 6, 2)], [("a", at(2), "1"), ("a", at(2), "1")])
    job.drain()
    merged = [("a", 0, "recorded", "merged"), ("a", 1, "idempotent", "merged"), ("a", 2, "conflict", "merged"),
              ("b", 5, "recorded", "merged"), ("b", 6, "idempotent", "merged")]
    assert job.out() == merged
    job.close()
    dead = [("-", 4, "unknown", "dead_letter"), ("ghost", 3, "unknown", "dead_letter")]
    assert job.out() == sorted(merged + dead)
    # hours behind the clock: still merged, nothing is dropped for being late
    job.give([("b", 1, at(10), 7, 3), ("a", 1, at(10), 8, 3), ("c", 1, at(0), 9, 3)], [("c", at(0), "1")])
    job.drain()
    assert job.out() == sorted(merged + dead + [("b", 7, "conflict", "merged"), ("a", 8, "idempotent", "merged"),
                                                ("c", 9, "recorded", "merged")])


def test_an_epoch_that_failed_after_its_write_adds_nothing_twice(spark, tmp_path, monkeypatch):
    job = LabelJob(spark, tmp_path)
    job.give([("a", 1, at(5), 0, 1), ("b", 1, at(6), 1, 1)], [("a", at(1), "1"), ("b", at(1), "1")])
    real = J.writer_id
    sink = K.write_epochs

    def write_then_fail(rows, path, checkpoint, by):
        def broken(batch, epoch):
            batch.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={real(checkpoint)}-{epoch}")
            raise RuntimeError("lost after the write")

        with K.state_store(spark):
            return J.run_available(rows.writeStream.foreachBatch(broken).option("checkpointLocation", checkpoint))

    monkeypatch.setattr(K, "write_epochs", write_then_fail)
    with pytest.raises(Exception, match="lost after the write"):
        job.drain()
    assert len(job.out()) == 2
    monkeypatch.setattr(K, "write_epochs", sink)
    job.drain()
    assert job.out() == [("a", 0, "recorded", "merged"), ("b", 1, "recorded", "merged")]


def test_ids_are_forgotten_after_their_time(spark, tmp_path):
    job = LabelJob(spark, tmp_path, keep_s=3600)
    job.give([("a", 1, at(5), 0, 1)], [(x, at(1), "1") for x in "abcdef"])
    job.drain()
    last = job.close()[-1]
    assert last["stateOperators"][0]["numRowsTotal"] == 0
    job.give([("a", 1, at(6), 1, 2)], [])
    job.drain()
    job.close()
    assert job.out() == [("a", 0, "recorded", "merged"), ("a", 1, "unknown", "dead_letter")]


def test_ids_share_a_state_and_keep_apart(spark, tmp_path, monkeypatch):
    """State rows grow with the groups of ids, not with the ids; every id waits, merges and is forgotten by itself."""
    monkeypatch.setattr(K, "ID_GROUPS", 4, raising=False)
    job = LabelJob(spark, tmp_path, keep_s=36_000)
    ids = [f"p{i}" for i in range(200)]
    # every 4th id: prediction first; 4th + 1: label waits for it; 4th + 2: none ever; 4th + 3: forgotten meanwhile
    job.give([(x, 1, at(1), i, 1) for i, x in enumerate(ids) if i % 4 in (0, 1, 2)],
             [(x, at(0), "1") for i, x in enumerate(ids) if i % 4 == 0] + [(x, at(-300), "1") for i, x in enumerate(ids) if i % 4 == 3])
    first = job.drain()
    assert first[-1]["stateOperators"][0]["numRowsTotal"] <= 4 * 3
    merged = [(x, i, "recorded", "merged") for i, x in enumerate(ids) if i % 4 == 0]
    assert job.out() == sorted(merged)
    K.heartbeat(spark, f"{tmp_path}/beats", at(120 + 30))          # under the hour that labels wait, and two of lateness
    job.drain()
    job.give([], [(x, at(140), "1") for i, x in enumerate(ids) if i % 4 == 1])
    job.drain()
    merged += [(x, i, "recorded", "merged") for i, x in enumerate(ids) if i % 4 == 1]
    assert job.out() == sorted(merged)
    K.heartbeat(spark, f"{tmp_path}/beats", at(120 + 400))         # the third kind is up, the fourth forgotten, the others not
    job.drain()
    unknown = [(x, i, "unknown", "dead_letter") for i, x in enumerate(ids) if i % 4 == 2]
    assert job.out() == sorted(merged + unknown)
    job.give([(x, 0, at(500), 1000 + i, 2) for i, x in enumerate(ids) if i % 4 != 2], [])
    job.drain()
    merged += [(x, 1000 + i, "conflict", "merged") for i, x in enumerate(ids) if i % 4 in (0, 1)]
    assert job.out() == sorted(merged + unknown)
    assert job.close()[-1]["stateOperators"][0]["numRowsTotal"] == 0
    unknown += [(x, 1000 + i, "unknown", "dead_letter") for i, x in enumerate(ids) if i % 4 == 3]
    assert job.out() == sorted(merged + unknown)


def test_rates_free_closed_windows_and_count_late_rows(spark, tmp_path):
    schema = "ts timestamp, route string, duration_s double, status int, prediction string"
    beats, src, out = f"{tmp_path}/beats", f"{tmp_path}/src", f"{tmp_path}/out"
    K.heartbeat(spark, beats)
    sent, progress = [], []

    def drain():
        return K.stream_rates(spark, src, spark.read.parquet(src).schema, out, f"{tmp_path}/ckpt", beats)

    for hour in range(6):  # each delivery an hour further, with one row a day late
        rows = [(at(60 * hour + m), f"/r{m % 3}", 0.25 * (m % 5), 500 if m % 7 == 0 else 200, "ATTACK" if m % 2 else "BENIGN")
                for m in range(60)]
        rows += [(at(-1440 + hour), "/old", 1.5, 200, "BENIGN")] * (hour > 0)
        sent += rows
        put(spark, rows, schema, src)
        progress += drain()
    # windows of the last 15 minutes may be open, no more
    assert all(p["stateOperators"][0]["numRowsTotal"] <= 3 * 4 * 12 for p in progress)
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 3 * 4
    K.heartbeat(spark, beats, END)
    assert drain()[-1]["stateOperators"][0]["numRowsTotal"] == 0
    got = {(r["window_start"], r["route"]): (r["requests"], r["errors_5xx"], round(r["mean_latency_s"] * r["requests"], 6),
                                             round(r["attack_share"] * r["requests"]), r["late_requests"])
           for r in K.read_rates(spark, out).collect()}
    want = {}
    for ts, route, d, status, p in sent:
        k = (ts - dt.timedelta(minutes=ts.minute % 5), route)
        n, e, s, a, late = want.get(k, (0, 0, 0.0, 0, 0))
        want[k] = (n + 1, e + (status >= 500), round(s + d, 6), a + (p == "ATTACK"), late + (route == "/old"))
    assert got == want
    assert sum(v[4] for v in got.values()) == 5


def test_log_epochs_do_constant_work(spark, tmp_path):
    """Fifty epochs, each with new rows and rows sent before: every key once, and an epoch writes and
    reads its own rows only (the folders of earlier epochs are never listed by the job)."""
    schema = "prediction_id string, timestamp timestamp, v int"
    src, log = f"{tmp_path}/src", f"{tmp_path}/log"
    for e in range(50):
        rows = [(f"p{e}-{i}", at(e), e) for i in range(4)] + [(f"p{max(e - 7, 0)}-{i}", at(max(e - 7, 0)), e) for i in range(3)]
        put(spark, rows, schema, src)
    progress = J.stream_log(spark, src, spark.read.parquet(src).schema, log, f"{tmp_path}/ckpt", max_files=1)
    read = [p["numInputRows"] for p in progress if p["numInputRows"]]
    assert len(read) == 50 and set(read) == {7}
    rows = spark.read.parquet(log)
    assert rows.count() == 200 == rows.select("prediction_id").distinct().count()
    assert {(r["prediction_id"].split("-")[0], r["v"]) for r in rows.collect()} == {(f"p{e}", e) for e in range(50)}
    # a restart with nothing new, then a repeat of everything
    J.stream_log(spark, src, spark.read.parquet(src).schema, log, f"{tmp_path}/ckpt")
    put(spark, spark.read.parquet(src).collect(), schema, src)
    J.stream_log(spark, src, spark.read.parquet(src).schema, log, f"{tmp_path}/ckpt")
    assert spark.read.parquet(log).count() == 200


def test_scores_equal_the_batch_path(spark, tmp_path):
    fields = ["x", "y"]
    train = spark.createDataFrame([(float(i % 9), float((i * 7) % 5), int(i % 9 > 4)) for i in range(90)], "x double, y double, target int")
    models = {}
    for v, c in (("1", 1.0), ("2", 0.01)):
        models[v] = f"{tmp_path}/m{v}"
        ML.save_model(ML.fit_logistic(train, fields, C=c, max_iter=30), models[v], fields)
    rows = [(f"p{i}", at(i), str(i % 3 + 1), f'{{"x": {i % 9}.0, "y": {i % 5}.5}}') for i in range(30)]
    rows += [("bad", at(1), "1", '{"x": 1}'), ("worse", at(1), "2", "no json"), ("none", at(2), None, '{"x": 1, "y": 2}'), rows[0]]
    put(spark, rows, "prediction_id string, timestamp timestamp, model_version string, features string", f"{tmp_path}/src")
    schema = spark.read.parquet(f"{tmp_path}/src").schema
    for _ in range(2):  # the second run has nothing to do
        SV.stream_score(spark, f"{tmp_path}/src", schema, "features", fields, models, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    got = {r["prediction_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 33 == spark.read.parquet(f"{tmp_path}/out").count()
    why = Counter(r["validation_category"] for r in got.values())
    assert why == {"valid": 20, "unknown_model_version": 11, "schema_mismatch": 1, "malformed_json": 1}
    from pyspark.ml import PipelineModel

    for v, folder in models.items():
        mine = spark.createDataFrame([(f"p{i}", float(i % 9), i % 5 + 0.5) for i in range(30) if str(i % 3 + 1) == v],
                                     "id string, x double, y double")
        for r in ML.score_table(PipelineModel.load(folder), mine, "id", v, F.current_timestamp()).collect():
            assert got[r["id"]]["score"] == r["score"] and got[r["id"]]["prediction"] == r["prediction"]
            assert got[r["id"]]["route"] == "scored"
    assert got["bad"]["score"] is None and got["bad"]["missing_fields"] == "y"


def test_monitor_carries_an_unchanged_window_over_a_restart(spark, tmp_path):
    schema = "prediction_id string, timestamp timestamp, prediction string, probability double, ground_truth int, x double"
    cfg = MonitoringConfig(window_size=40, minimum_window_size=10, minimum_labelled_rows=5)
    reference = spark.createDataFrame([("x", float(i)) for i in range(100)], "feature string, x double")

    def rows(a, b, label):
        return [(f"p{i:04d}", at(i), "ATTACK" if i % 2 else "BENIGN", i / 1000, label(i), float(i % 100)) for i in range(a, b)]

    def cycle():
        SV.stream_monitor(spark, f"{tmp_path}/src", spark.read.parquet(f"{tmp_path}/src").schema, reference, ["x"], cfg,
                          str(tmp_path), f"{tmp_path}/ckpt")
        return [tuple(r) for r in SV.read_ledger(spark, str(tmp_path)).orderBy("epoch").select(
            "epoch", "action", "report_epoch", "window_rows", "attack_count").collect()]

    put(spark, rows(0, 5, lambda i: None), schema, f"{tmp_path}/src")
    assert cycle() == [(0, "computed", 0, 5, 2)]
    put(spark, rows(100, 160, lambda i: i % 2), schema, f"{tmp_path}/src")
    assert cycle()[1:] == [(1, "computed", 1, 40, 20)]
    put(spark, rows(50, 60, lambda i: 1), schema, f"{tmp_path}/src")       # older than the window
    assert cycle()[2:] == [(2, "skipped_unchanged_input", 1, 40, 20)]
    put(spark, rows(60, 70, lambda i: 0), schema, f"{tmp_path}/src")
    assert cycle()[3:] == [(3, "skipped_unchanged_input", 1, 40, 20)]
    put(spark, rows(160, 161, lambda i: 1), schema, f"{tmp_path}/src")
    assert [r[:3] for r in cycle()[4:]] == [(4, "computed", 4)]

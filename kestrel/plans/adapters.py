"""Adapters: the driver's tables -> the model-data shapes the operators consume.

Each adapter has a SQL twin in ``kestrel.plans.oracle`` so DuckDB can rebuild the
same rows independently. Injected defects (missing / infinite cells, unknown
labels, repeated or conflicting labels) are keyed on ids with plain modulo
arithmetic so both engines inject exactly the same rows; they never remove rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.clean import prepare_flows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- flows: lineitem as labelled network-flow captures ------------------------------------------
FLOW_HEADER = ("Line Number", " Quantity", " Discount", " Tax", " Label")
FLOW_FEATURES = ("line_number", "quantity", "discount", "tax")
FLOW_LABEL_POSITION = 4


def _dec(c):
    return F.col(c).cast("decimal(18,2)").cast("string")


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, source_row_number, line) as a CSV capture would give.

    Weekday of ``l_shipdate`` names the capture file (Saturday and Sunday count as Monday and Tuesday),
    ``l_linestatus`` picks the morning/afternoon file, ``l_returnflag`` the label.
    Defects: tax 'Infinity' when orderkey % 101 = 0, empty quantity when % 211 = 0,
    unknown label 'Mystery' when % 997 = 0.
    """
    li = table(spark, sf_dir, "lineitem")
    # weekday name by array lookup (dayofweek: 1 = Sunday) instead of a per-row date formatter
    # captures have five days: what ships on Saturday counts as Monday's, on Sunday as Tuesday's
    names = F.array(*[F.lit(d) for d in ("Tuesday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Monday")])
    day = F.element_at(names, F.dayofweek("l_shipdate"))
    half = F.when(F.col("l_linestatus") == "O", F.lit("Morning")).otherwise(F.lit("Afternoon"))
    label = (F.when(F.col("l_orderkey") % 997 == 0, F.lit("Mystery"))
             .when(F.col("l_returnflag") == "N", F.lit("BENIGN"))
             .when(F.col("l_returnflag") == "R", F.lit("DoS Hulk"))
             .otherwise(F.lit("PortScan")))
    qty = F.when(F.col("l_orderkey") % 211 == 0, F.lit("")).otherwise(_dec("l_quantity"))
    tax = F.when(F.col("l_orderkey") % 101 == 0, F.lit("Infinity")).otherwise(_dec("l_tax"))
    line = F.concat_ws(",", F.col("l_linenumber").cast("string"), qty, _dec("l_discount"), tax, label)
    return (li.withColumn("_day", day)
            .select(F.concat(F.col("_day"), F.lit("-WorkingHours-"), half, F.lit(".pcap_ISCX.csv")).alias("source_file"),
                    (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("source_row_number"),
                    line.alias("line")))


def flows_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_flows(raw_flows(spark, sf_dir), FLOW_FEATURES, FLOW_LABEL_POSITION)


def kept_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flows_processed`` without the file names, written once to the shared checkpoint folder, a folder a
    source partition, for steps that read it more than once."""
    import uuid

    from kestrel.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark)}/flows-{uuid.uuid4().hex}"
    rows = flows_processed(spark, sf_dir).select("row_digest", "target", *FLOW_FEATURES, "source_partition")
    rows.write.partitionBy("source_partition").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


# --- scored: documents with a toxicity label and a length-based score ---------------------------
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels join documents: target = toxic, score = least(1, n_chars / 8000) (ties, imbalance)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return lab.join(docs, "doc_id").select(
        "doc_id", "lang", "source", F.col("toxic").alias("target"),
        F.least(F.lit(1.0), F.col("n_chars") / F.lit(8000.0)).alias("score"))


def payload_json():
    """Feature payload text with injected defects (missing, extra, boolean, string, overflow,
    malformed, NaN, duplicate key, array) keyed on event_id residues."""
    e = F.col("event_id")
    v = F.col("value").cast("decimal(18,2)").cast("string")
    k = F.get_json_object("props", "$.k")
    return (F.when(e % 41 == 0, F.concat(F.lit('{"k": '), k, F.lit("}")))
            .when(e % 43 == 0, F.concat(F.lit('{"value": '), v, F.lit(', "k": '), k, F.lit(', "extra": 1}')))
            .when(e % 47 == 0, F.concat(F.lit('{"value": true, "k": '), k, F.lit("}")))
            .when(e % 53 == 0, F.concat(F.lit('{"value": "'), v, F.lit('", "k": '), k, F.lit("}")))
            .when(e % 59 == 0, F.concat(F.lit('{"value": 1e999, "k": '), k, F.lit("}")))
            .when(e % 61 == 0, F.lit("{not-json"))
            .when(e % 67 == 0, F.concat(F.lit('{"value": NaN, "k": '), k, F.lit("}")))
            .when(e % 71 == 0, F.concat(F.lit('{"value": '), v, F.lit(', "value": '), v, F.lit(', "k": '), k, F.lit("}")))
            .when(e % 73 == 0, F.concat(F.lit("["), v, F.lit(", "), k, F.lit("]")))
            .otherwise(F.concat(F.lit('{"value": '), v, F.lit(', "k": '), k, F.lit("}"))))


PAYLOAD_FIELDS = ("value", "k")


# --- predictions: events as a scored prediction log ---------------------------------------------
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per event; version = user_id % 3 + 1; ATTACK iff error/signup.

    Features (JSON payload and typed): value and k (from props). Ground truth arrives
    ``event_id % 600`` seconds after the prediction, except for every fifth event
    (``event_id % 5 = 4``) whose label never arrives.
    """
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    labelled = F.col("event_id") % 5 != 4
    truth = F.when(F.col("event_id") % 7 < 3, F.lit(1)).otherwise(F.lit(0))
    return ev.select(
        F.concat(F.lit("pred-"), F.col("event_id").cast("string")).alias("prediction_id"),
        "event_id", F.col("ts").alias("timestamp"),
        (F.col("user_id") % 3 + 1).cast("string").alias("model_version"),
        F.when(F.col("event_type").isin("error", "signup"), F.lit("ATTACK")).otherwise(F.lit("BENIGN")).alias("prediction"),
        F.least(F.lit(1.0), F.col("value") / F.lit(500.0)).alias("probability"),
        F.col("value"), k.alias("k"), payload_json().alias("features"), F.col("event_type"),
        F.when(labelled, truth).alias("ground_truth"),
        F.when(labelled, F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 600).cast("int"))
               ).alias("ground_truth_received_at"))


def _label_struct(pid, label, arrival, seq):
    return F.struct(pid.alias("prediction_id"), label.alias("label"), arrival.alias("arrival"), F.lit(seq).alias("seq"))


def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late label deliveries (prediction_id, label, arrival, seq, batch_id).

    First delivery for every labelled event; a repeat of the same label when
    event_id % 50 = 0; a conflicting second label when event_id % 97 = 0; a label for an
    unknown id when event_id % 89 = 0. Batches of 25 consecutive event ids.
    """
    ev = table(spark, sf_dir, "events").filter(F.col("event_id") % 5 != 4)
    pid = F.concat(F.lit("pred-"), F.col("event_id").cast("string"))
    truth = F.when(F.col("event_id") % 7 < 3, F.lit(1)).otherwise(F.lit(0))
    arrive = F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 600).cast("int"))
    ev_id = F.col("event_id")
    variants = F.array(
        F.struct(pid.alias("prediction_id"), truth.alias("label"), arrive.alias("arrival"), F.lit(0).alias("seq")),
        F.when(ev_id % 50 == 0, _label_struct(pid, truth, arrive + F.expr("INTERVAL 60 SECONDS"), 1)),
        F.when(ev_id % 97 == 0, _label_struct(pid, 1 - truth, arrive + F.expr("INTERVAL 120 SECONDS"), 2)),
        F.when(ev_id % 89 == 0, _label_struct(F.concat(F.lit("unknown-"), ev_id.cast("string")), truth, arrive, 3)))
    return (ev.select(ev_id, F.explode(F.filter(variants, lambda v: v.isNotNull())).alias("v"))
            .select(F.col("v.prediction_id").alias("prediction_id"), F.col("v.label").alias("label"),
                    F.col("v.arrival").alias("arrival"), F.col("v.seq").alias("seq"),
                    F.floor(ev_id / 25).alias("batch_id")))


# --- windows: events split in time into a reference half and a current half ---------------------
SPLIT_TS = "2024-01-16 00:00:00"
WINDOW_FEATURES = ("value", "k", "alert_flag", "value_shifted")


def drift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(side, value, k, alert_flag, value_shifted); side = reference before SPLIT_TS else current.

    ``alert_flag`` widens its definition on the current side (error -> error or click);
    ``value_shifted`` applies a gradual-free scenario on the current side (x * 1.25 + 50).
    """
    ev = table(spark, sf_dir, "events")
    is_ref = F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz")
    flag = F.when(is_ref, F.col("event_type") == "error").otherwise(F.col("event_type").isin("error", "click"))
    return ev.select(
        F.when(is_ref, F.lit("reference")).otherwise(F.lit("current")).alias("side"),
        F.col("value"), F.get_json_object("props", "$.k").cast("double").alias("k"),
        flag.cast("double").alias("alert_flag"),
        F.when(is_ref, F.col("value")).otherwise(F.col("value") * 1.25 + 50).alias("value_shifted"))


# --- raw_orders: orders as raw capture files with every token class -----------------------------
ORDER_HEADER = ("Order Key", " Cust Key", " Total Price", " Order Date", " Priority Code", " Constant",
                " Near Constant", " Fwd Header Length", " Fwd Header Length", " Label")
ORDER_DAYS = {"1-URGENT": "Monday", "2-HIGH": "Tuesday", "3-MEDIUM": "Wednesday", "4-NOT SPECIFIED": "Thursday",
              "5-LOW": "Friday"}


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, source_row_number, line) with missing, NaN, +/-inf, exponent, junk and
    pseudo-float tokens injected by o_orderkey residues; a constant and a near-constant
    column; a duplicated column name; label from the order status (F benign, O DDoS, P Bot).
    """
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.coalesce(*[F.when(F.col("o_orderpriority") == p, F.lit(d)) for p, d in ORDER_DAYS.items()])
    fname = F.concat(day, F.lit("-Orders-"), F.regexp_replace("o_orderpriority", " ", "_"), F.lit(".pcap_ISCX.csv"))
    cust = (F.when(k % 13 == 0, F.lit("")).when(k % 17 == 0, F.lit("NaN")).otherwise(F.col("o_custkey").cast("string")))
    price = (F.when(k % 19 == 0, F.lit("Infinity")).when(k % 23 == 0, F.lit("-inf")).when(k % 29 == 0, F.lit("1e5"))
             .when(k % 41 == 0, F.lit("1.2.3")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    prio = (F.when(k % 31 == 0, F.lit("x")).when(k % 37 == 0, F.lit("1d"))
            .otherwise(F.substring("o_orderpriority", 1, 1)))
    near = F.when(k % 1000 == 7, F.lit("1")).otherwise(F.lit("0"))
    fwd = (F.col("o_custkey") % 100).cast("string")
    label = (F.when(F.col("o_orderstatus") == "F", F.lit("BENIGN")).when(F.col("o_orderstatus") == "O", F.lit("DDoS"))
             .otherwise(F.lit("Bot")))
    line = F.concat_ws(",", k.cast("string"), cust, price, F.date_format("o_orderdate", "yyyy-MM-dd"), prio,
                       F.lit("0"), near, fwd, fwd, label)
    return o.select(fname.alias("source_file"), k.alias("source_row_number"), line.alias("line"))


def order_headers(raw: DataFrame) -> DataFrame:
    """Header rows per capture file (source_file, col_index, column_name); the Friday file
    writes its price header without the leading blank (trimmed-equal, not exact-equal)."""
    files = raw.select("source_file").distinct()
    arr = F.array(*[F.struct(F.lit(i).alias("col_index"), F.lit(h).alias("column_name"))
                    for i, h in enumerate(ORDER_HEADER)])
    exploded = files.select("source_file", F.inline(arr))
    fix = (F.col("source_file").startswith("Friday") & (F.col("col_index") == 2))
    return exploded.select("source_file", "col_index",
                           F.when(fix, F.trim("column_name")).otherwise(F.col("column_name")).alias("column_name"))


# --- documents: text rows split into partitions by source --------------------------------------
def doc_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, source_partition, row_digest): sources numbered 0,1,2 mod 5 train,
    3 validation, 4 test; digest = SHA-256 of the whole text (exact copies collide)."""
    d = table(spark, sf_dir, "documents")
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 5
    part = F.when(n <= 2, F.lit("train")).when(n == 3, F.lit("validation")).otherwise(F.lit("test"))
    return d.select("doc_id", "source", part.alias("source_partition"), F.sha2("text", 256).alias("row_digest"))


def queue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSONL dead-letter queue of a log sink that failed: one line per event. Blank lines (event_id
    % 40 = 13, with a tab when % 80 = 13), malformed lines (% 70 = 3), empty ids (% 90 = 23) and
    numeric ids, 0 among them (% 110 = 7, 0 unless % 4 = 1), injected."""
    ev = table(spark, sf_dir, "events")
    e = F.col("event_id")
    pid = F.concat(F.lit("pred-"), e.cast("string"))
    good = F.concat(F.lit('{"prediction_id": "'), pid, F.lit('", "model_version": "'),
                    (F.col("user_id") % 3 + 1).cast("string"), F.lit('"}'))
    line = (F.when(e % 80 == 13, F.lit(" \t")).when(e % 40 == 13, F.lit("")).when(e % 70 == 3, F.lit("{not-json"))
            .when(e % 90 == 23, F.lit('{"prediction_id": ""}'))
            .when(e % 110 == 7, F.concat(F.lit('{"prediction_id": '), F.when(e % 4 == 1, e).otherwise(F.lit(0)).cast("string"), F.lit("}")))
            .otherwise(good))
    return ev.select(e.alias("line_no"), line.alias("value"))


def replay_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A re-sent prediction batch overlapping the stored log: events from 2024-01-10 on,
    each sent once and re-sent (attempt 2, different latency) when event_id % 50 = 0."""
    ev = table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    e = F.col("event_id")
    attempts = F.when(e % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return ev.select(F.concat(F.lit("pred-"), e.cast("string")).alias("prediction_id"), "ts",
                     F.explode(attempts).alias("attempt"), (e % 7).alias("_r")).select(
        "prediction_id", "ts", "attempt", (F.col("attempt") * 10 + F.col("_r")).cast("double").alias("latency_ms"))


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction log already stored: events before 2024-01-16."""
    ev = table(spark, sf_dir, "events").filter(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    return ev.select(F.concat(F.lit("pred-"), F.col("event_id").cast("string")).alias("prediction_id"), "ts")


# --- monitoring inputs -----------------------------------------------------------------------------
MONITOR_FEATURES = ("value", "k")
REFERENCE_END = "2024-01-08 00:00:00"


def monitored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log with the typed payload features (null where the payload is not valid)."""
    from kestrel.operators.serving import validate_features

    v = validate_features(predictions(spark, sf_dir), "features", PAYLOAD_FIELDS)
    return v.select("prediction_id", "event_id", "timestamp", "model_version", "prediction", "probability",
                    "ground_truth", "ground_truth_received_at",
                    *[F.col("features_typed")[f].alias(f) for f in MONITOR_FEATURES])


def typed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction log with parsed, typed features, written once to the shared checkpoint folder:
    every monitoring aggregate reads this narrow table instead of re-parsing JSON payloads."""
    from kestrel.session import materialize

    return materialize(monitored_predictions(spark, sf_dir).select(
        "prediction_id", "timestamp", "model_version", "prediction", "probability", "ground_truth", *MONITOR_FEATURES))


def monitoring_reference(spark: SparkSession, sf_dir: str, n: int = 5000, seed: int = 42,
                         log: DataFrame | None = None) -> DataFrame:
    """Seeded sample of the first week's predictions: the drift reference (tall form)."""
    from kestrel.operators.drift import unpivot
    from kestrel.operators.sampling import sample_n

    from kestrel.session import materialize

    src = log if log is not None else monitored_predictions(spark, sf_dir)
    early = src.filter(F.col("timestamp") < F.lit(REFERENCE_END).cast("timestamp_ntz"))
    # the sample is bounded by n and read by every drift step: checkpoint it once
    return unpivot(materialize(sample_n(early, n, seed, "prediction_id").select(*MONITOR_FEATURES)), MONITOR_FEATURES)


# --- retraining state derived from the prediction log -------------------------------------------------
def retraining_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retraining run per day of predictions: starts 02:00, lasts one second per prediction of the
    day; final status by day-of-month % 4 (0 failed, 1 promoted, 2 rejected, 3 promotion_pending)."""
    ev = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    per = ev.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    start = F.to_timestamp_ntz(F.col("day")) + F.expr("INTERVAL 2 HOURS")
    dom = F.dayofmonth(F.to_date("day")) % 4
    status = (F.when(dom == 0, F.lit("failed")).when(dom == 1, F.lit("promoted")).when(dom == 2, F.lit("rejected"))
              .otherwise(F.lit("promotion_pending")))
    return per.select(F.concat(F.lit("run-"), F.col("day")).alias("retraining_run_id"), start.alias("started_at"),
                      (start + F.make_dt_interval(secs=F.col("n").cast("int"))).alias("finished_at"),
                      status.alias("final_status"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled observations: first label per prediction, payload validation, approval status."""
    from kestrel.operators.serving import labelled_view, validate_features, validate_observation

    v = labelled_view(predictions(spark, sf_dir), label_events(spark, sf_dir)).filter(F.col("ground_truth").isNotNull())
    o = validate_observation(validate_features(v, "features", PAYLOAD_FIELDS))
    return o.select("prediction_id", "event_id", F.col("ground_truth_received_at").alias("staged_at"), "ground_truth",
                    "model_version", "validation_status", "validation_errors",
                    *[F.col("features_typed")[f].alias(f) for f in MONITOR_FEATURES])


def kept_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations, joined and parsed once and written to the shared checkpoint folder, for steps that
    read them more than once (as observed and as consumed)."""
    from kestrel.llm.common import written

    return written(observations(spark, sf_dir), "observations")


def consumed_observations(spark: SparkSession, sf_dir: str, observed: DataFrame | None = None) -> DataFrame:
    """Approved observations with event_id % 3 = 0 were consumed by the run of their staging day."""
    seen = observations(spark, sf_dir) if observed is None else observed
    o = seen.filter((F.col("validation_status") == "approved") & (F.col("event_id") % 3 == 0))
    return o.select("prediction_id", F.concat(F.lit("run-"), F.date_format("staged_at", "yyyy-MM-dd")).alias(
        "retraining_run_id"))


# --- per-version evaluation metrics from the labelled prediction log ---------------------------------
def version_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled predictions (first label wins) with 0/1 prediction and score, per model version."""
    from kestrel.operators.serving import labelled_view

    v = labelled_view(predictions(spark, sf_dir), label_events(spark, sf_dir)).filter(F.col("ground_truth").isNotNull())
    return v.select("model_version", "prediction_id", F.col("ground_truth").alias("target"),
                    F.when(F.col("prediction") == "ATTACK", 1).otherwise(0).alias("pred"),
                    F.col("probability").alias("score"), (F.col("value") / 10000.0).alias("latency_ms"))


def version_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tall (model_version, metric, value) plus evaluated row counts."""
    from kestrel.operators import metrics as M

    ev = version_eval(spark, sf_dir)
    rates = M.rates_from_confusion(M.confusion_matrix(ev, "target", "pred", ["model_version"]))
    rank = M.ranking_metrics(ev, "target", "score", ["model_version"])
    lat = ev.groupBy("model_version").agg(F.avg("latency_ms").alias("inference_latency_ms_per_row"))
    wide = rates.join(rank, "model_version").join(lat, "model_version").select(
        "model_version", "rows", F.col("average_precision").alias("pr_auc"), F.col("recall").alias("attack_class_recall"),
        "f1", "false_positive_rate", "inference_latency_ms_per_row", "roc_auc")
    return wide.unpivot(["model_version", "rows"], ["pr_auc", "attack_class_recall", "f1", "false_positive_rate",
                                                    "inference_latency_ms_per_row", "roc_auc"], "metric", "value")


# --- probation inputs ----------------------------------------------------------------------------------
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One promotion per day: version d % 3 + 1 replaces (d - 1) % 3 + 1 at 06:00 (day 1 has no previous champion)."""
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    d = F.dayofmonth(F.to_date("day"))
    return days.select(F.concat(F.lit("prob-"), F.col("day")).alias("probation_id"),
                       (d % 3 + 1).cast("string").alias("promoted_version"),
                       F.when(d > 1, ((d - 1) % 3 + 1).cast("string")).alias("previous_champion_version"),
                       (F.to_timestamp_ntz(F.col("day")) + F.expr("INTERVAL 6 HOURS")).alias("promoted_at"))


def probation_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).select("prediction_id", "ground_truth", "validation_status")
    p = predictions(spark, sf_dir).select("prediction_id", "timestamp", "model_version", "prediction")
    return p.join(o, "prediction_id")


def rollback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded rollbacks: successful on days 2, 5 and 8 (day 5 twice), a failed attempt on day 11."""
    pr = promotions(spark, sf_dir)
    d = F.dayofmonth(F.to_date(F.substring("probation_id", 6, 10)))
    base = pr.filter(d.isin(2, 5, 8, 11)).select("probation_id", F.col("previous_champion_version").alias("target_version"),
                                                (F.col("promoted_at") + F.expr("INTERVAL 7 HOURS")).alias("rolled_back_at"),
                                                (d != 11).alias("succeeded"), d.alias("_d"))
    again = base.filter(F.col("_d") == 5).withColumn("rolled_back_at", F.col("rolled_back_at") + F.expr("INTERVAL 1 HOUR"))
    both = base.unionByName(again)
    return both.select(F.concat(F.lit("rb-"), F.date_format("rolled_back_at", "yyyyMMddHH")).alias("rollback_id"),
                       "probation_id", "target_version", "rolled_back_at", "succeeded")

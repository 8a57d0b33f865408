"""Registered queries: monitoring window, report, fingerprints, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.contracts import MonitoringConfig
from kestrel.operators import monitoring as MON
from kestrel.operators import sampling as SA
from kestrel.plans import adapters as A
from kestrel.plans import oracle as O
from kestrel.plans.registry import register

MON_SQL = O.with_ctes(O.PREDICTIONS, O.MONITORED)
CFG = MonitoringConfig(window_size=500, minimum_window_size=50, drift_share_threshold=0.30, psi_threshold=0.20,
                       minimum_labelled_rows=20)


@register("scan_predictions_window", MON_SQL + """
SELECT prediction_id, "timestamp", prediction, round(probability, 6) AS probability, CAST(ground_truth AS DOUBLE) AS ground_truth
FROM monitored ORDER BY "timestamp" DESC, prediction_id DESC LIMIT 500""")
def q_scan_predictions_window(spark: SparkSession, sf: str) -> DataFrame:
    w = MON.latest_window(A.monitored_predictions(spark, sf), CFG.window_size)
    return w.select("prediction_id", "timestamp", "prediction", F.round("probability", 6).alias("probability"),
                    F.col("ground_truth").cast("double").alias("ground_truth")).orderBy("timestamp", "prediction_id")


@register("latest_n", MON_SQL + """
SELECT model_version, prediction_id, "timestamp" FROM monitored
QUALIFY row_number() OVER (PARTITION BY model_version ORDER BY "timestamp" DESC, prediction_id DESC) <= 50""")
def q_latest_n(spark: SparkSession, sf: str) -> DataFrame:
    """The latest 50 predictions of each model version (a top-k per group)."""
    rank = F.expr("row_number() OVER (PARTITION BY model_version ORDER BY `timestamp` DESC, prediction_id DESC)")
    p = A.predictions(spark, sf).select("model_version", "prediction_id", "timestamp")
    return p.withColumn("_r", rank).where("_r <= 50").drop("_r")


@register("sample_n", MON_SQL + "\nSELECT prediction_id FROM reference_rows")
def q_sample_n(spark: SparkSession, sf: str) -> DataFrame:
    early = A.monitored_predictions(spark, sf).filter(F.col("timestamp") < F.lit(A.REFERENCE_END).cast("timestamp_ntz"))
    return SA.sample_n(early, 5000, 42, "prediction_id").select("prediction_id")


def _report_sql(window_cte: str, cur_keys: str, group_select: str) -> str:
    ck = (cur_keys + ", ") if cur_keys else ""
    return MON_SQL + ",\n" + window_cte + """,
win_tall AS (UNPIVOT (SELECT """ + ck + """value, k FROM win) ON value, k INTO NAME feature VALUE x),""" + O.psi_sql(
        "reference_tall", "win_tall", "feature", cur_keys) + """,
drift AS (SELECT """ + ck + """count(*) AS monitored_feature_count, count(*) FILTER (WHERE psi >= 0.2) AS drifting_feature_count,
                 count(*) FILTER (WHERE psi >= 0.2) / count(*) AS drift_share,
                 COALESCE(array_to_string(list_sort(list(feature) FILTER (WHERE psi >= 0.2)), '|'), '') AS drifting_features
          FROM psi_out GROUP BY ALL),
perf AS (SELECT """ + ck + """count(*) AS window_rows, count(ground_truth) AS labelled_rows,
                count(*) FILTER (WHERE ground_truth = 1) AS true_attack, count(*) FILTER (WHERE ground_truth = 0) AS true_benign,
                count(*) FILTER (WHERE prediction = 'ATTACK' AND ground_truth = 1) AS tp,
                count(*) FILTER (WHERE prediction = 'BENIGN' AND ground_truth = 1) AS fn,
                count(*) FILTER (WHERE prediction = 'ATTACK' AND ground_truth = 0) AS fp,
                count(*) FILTER (WHERE prediction = 'BENIGN' AND ground_truth = 0) AS tn,
                count(*) FILTER (WHERE prediction = 'ATTACK') AS attack_count,
                count(*) FILTER (WHERE prediction <> 'ATTACK') AS benign_count
         FROM win GROUP BY ALL),
j AS (SELECT p.*, d.monitored_feature_count, d.drifting_feature_count, d.drift_share, d.drifting_features,
             labelled_rows >= 20 AND true_attack >= 1 AND true_benign >= 1 AS ok,
             tp / NULLIF(tp + fn, 0) AS rec, tp / NULLIF(tp + fp, 0) AS prec
      FROM perf p LEFT JOIN drift d """ + (f"USING ({cur_keys})" if cur_keys else "ON true") + """)
SELECT """ + group_select + """window_rows, CASE WHEN window_rows < 50 THEN 'warming_up' ELSE 'ok' END AS status,
       CASE WHEN window_rows >= 50 THEN monitored_feature_count END AS monitored_feature_count,
       CASE WHEN window_rows >= 50 THEN drifting_feature_count END AS drifting_feature_count,
       CASE WHEN window_rows >= 50 THEN round(drift_share, 6) END AS drift_share,
       CASE WHEN window_rows >= 50 THEN drift_share >= 0.3 END AS data_drift_detected,
       CASE WHEN window_rows >= 50 THEN drifting_features END AS drifting_features,
       CASE WHEN ok THEN 'available' ELSE 'insufficient_labels' END AS performance_status,
       labelled_rows, true_attack, true_benign,
       CASE WHEN ok THEN round(rec, 6) END AS attack_recall, CASE WHEN ok THEN round(prec, 6) END AS precision,
       CASE WHEN ok THEN round(CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END, 6) END AS f1,
       CASE WHEN ok THEN round(fp / NULLIF(fp + tn, 0), 6) END AS false_positive_rate,
       CASE WHEN ok THEN round((tp + tn) / labelled_rows, 6) END AS accuracy,
       attack_count, benign_count, round(attack_count / window_rows, 6) AS attack_share
FROM j"""


def _report_out(r: DataFrame, by) -> DataFrame:
    rnd = ["drift_share", "attack_recall", "precision", "f1", "false_positive_rate", "accuracy", "attack_share"]
    cols = []
    for c in r.columns:
        if c in rnd:
            cols.append(F.round(c, 6).alias(c))
        elif c == "drifting_features":
            cols.append(F.array_join(F.filter(c, lambda x: x.isNotNull()), "|").alias(c))
        else:
            cols.append(F.col(c))
    return r.select(*cols)


@register("monitoring_report", _report_sql(
    """win AS (SELECT * FROM monitored ORDER BY "timestamp" DESC, prediction_id DESC LIMIT 500)""", "", ""))
def q_monitoring_report(spark: SparkSession, sf: str) -> DataFrame:
    win = MON.latest_window(A.monitored_predictions(spark, sf), CFG.window_size)
    r = MON.monitoring_report(win, A.monitoring_reference(spark, sf), A.MONITOR_FEATURES, CFG)
    return _report_out(r, [])


def daily_reports(spark: SparkSession, sf: str) -> DataFrame:
    """One monitoring report per (day, model version): the window is that group's predictions."""
    log = A.typed_log(spark, sf)
    p = log.withColumn("report_day", F.date_format("timestamp", "yyyy-MM-dd"))
    return MON.monitoring_report(p, A.monitoring_reference(spark, sf, log=log), A.MONITOR_FEATURES, CFG,
                                 ["report_day", "model_version"])


def daily_sql() -> str:
    return _report_sql("""win AS (SELECT *, strftime("timestamp", '%Y-%m-%d') AS report_day FROM monitored)""",
                       "report_day, model_version", "report_day, model_version, ")


@register("monitoring_report_daily", daily_sql())
def q_monitoring_report_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _report_out(daily_reports(spark, sf), ["report_day", "model_version"])


def _fp_sql(text: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || ':' ||
  CAST(sum(('0x' || substr(sha256({text}), 1, 15))::UBIGINT) AS VARCHAR) || ':' ||
  CAST(sum(('0x' || substr(sha256({text}), 16, 15))::UBIGINT) AS VARCHAR)) AS fingerprint"""


_ROW_TEXT = """prediction_id || '|' || CAST(CAST(probability AS DECIMAL(18,6)) AS VARCHAR)"""


@register("dataset_fingerprint", O.with_ctes(O.PREDICTIONS) + "\n" + _fp_sql(_ROW_TEXT, "model_version") +
          "\nFROM predictions GROUP BY model_version")
def q_dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    p = A.predictions(spark, sf)
    text = F.concat(F.col("prediction_id"), F.lit("|"), F.col("probability").cast("decimal(18,6)").cast("string"))
    return MON.dataset_fingerprint(p, text, ["model_version"])


@register("monitoring_fingerprint", MON_SQL + """,
win AS (SELECT * FROM monitored ORDER BY "timestamp" DESC, prediction_id DESC LIMIT 500),
wf AS (""" + _fp_sql(_ROW_TEXT.replace("prediction_id ||", "prediction_id || '|' || COALESCE(CAST(ground_truth AS VARCHAR), '-') ||"),
                     "'window' AS part") + """ FROM win),
rf AS (""" + _fp_sql("prediction_id", "'reference' AS part") + """ FROM reference_rows)
SELECT sha256(wf.fingerprint || ':' || rf.fingerprint || ':' || 'k|value' || ':' || 'psi=0.2;share=0.3;window=500;min=50')
         AS monitoring_fingerprint, wf.rows AS window_rows, rf.rows AS reference_rows
FROM wf, rf""")
def q_monitoring_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Identity of the window rows (labels included), the reference, the schema and the config."""
    mp = A.monitored_predictions(spark, sf)
    win = MON.latest_window(mp, CFG.window_size)
    wtext = F.concat(F.col("prediction_id"), F.lit("|"), F.coalesce(F.col("ground_truth").cast("string"), F.lit("-")),
                     F.lit("|"), F.col("probability").cast("decimal(18,6)").cast("string"))
    wf = MON.dataset_fingerprint(win.withColumn("_k", F.lit(1)), wtext, ["_k"])
    early = mp.filter(F.col("timestamp") < F.lit(A.REFERENCE_END).cast("timestamp_ntz"))
    ref = SA.sample_n(early, 5000, 42, "prediction_id")
    rf = MON.dataset_fingerprint(ref.withColumn("_k", F.lit(1)), F.col("prediction_id"), ["_k"])
    schema_text = "|".join(sorted(A.MONITOR_FEATURES))
    cfg_text = f"psi={CFG.psi_threshold};share={CFG.drift_share_threshold:.1f};window={CFG.window_size};min={CFG.minimum_window_size}"
    j = wf.select("_k", F.col("fingerprint").alias("wfp"), F.col("rows").alias("window_rows")).join(
        rf.select("_k", F.col("fingerprint").alias("rfp"), F.col("rows").alias("reference_rows")), "_k")
    fp = F.sha2(F.concat_ws(":", "wfp", "rfp", F.lit(schema_text), F.lit(cfg_text)), 256)
    return j.select(fp.alias("monitoring_fingerprint"), "window_rows", "reference_rows")


@register("row_fingerprint", O.with_ctes(O.RAW_FLOWS) + """
SELECT source_partition, count(*) AS rows,
       count(DISTINCT (line_number, quantity, discount, tax, target)) AS distinct_fingerprints
FROM processed GROUP BY ALL""")
def q_row_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    p = A.flows_processed(spark, sf).withColumn("fp", MON.row_fingerprint(A.FLOW_FEATURES, "target"))
    per = p.groupBy("source_partition", "fp").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source_partition").agg(F.sum("n").cast("bigint").alias("rows"),
                                               F.count(F.lit(1)).alias("distinct_fingerprints"))


# ---- sampling --------------------------------------------------------------------------------------
FLOW_SQL = O.with_ctes(O.RAW_FLOWS)


def _alloc_sql(n: int) -> str:
    return f""",
cnt AS (SELECT source_partition, count(*) FILTER (WHERE target = 0) AS c0, count(*) FILTER (WHERE target = 1) AS c1
        FROM processed GROUP BY ALL),
a AS (SELECT *, greatest(1, least(c0, CAST(floor({n} * (c0 / (c0 + c1))) AS BIGINT))) AS a0,
             greatest(1, least(c1, CAST(floor({n} * (c1 / (c0 + c1))) AS BIGINT))) AS a1 FROM cnt),
b AS (SELECT *, greatest({n} - a0 - a1, 0) AS d, abs((c0 - a0) - (c1 - a1)) AS gap, (c0 - a0) >= (c1 - a1) AS to0 FROM a),
c AS (SELECT *, a0 + CASE WHEN to0 THEN least(d, gap) ELSE 0 END + CAST(ceil((d - least(d, gap)) / 2) AS BIGINT) AS b0,
             a1 + CASE WHEN to0 THEN 0 ELSE least(d, gap) END + CAST(floor((d - least(d, gap)) / 2) AS BIGINT) AS b1 FROM b),
e AS (SELECT *, greatest(b0 + b1 - {n}, 0) AS over, abs(b0 - b1) AS g2, b0 >= b1 AS big0 FROM c),
alloc AS (SELECT source_partition, c0, c1,
          CASE WHEN {n} >= c0 + c1 THEN c0 ELSE greatest(1, b0 - (CASE WHEN big0 THEN least(over, g2) ELSE 0 END
               + CAST(ceil((over - least(over, g2)) / 2) AS BIGINT))) END AS quota_0,
          CASE WHEN {n} >= c0 + c1 THEN c1 ELSE greatest(1, b1 - (CASE WHEN big0 THEN 0 ELSE least(over, g2) END
               + CAST(floor((over - least(over, g2)) / 2) AS BIGINT))) END AS quota_1
          FROM e)"""


@register("stratified_allocation", FLOW_SQL + _alloc_sql(1000) + "\nSELECT * FROM alloc")
def q_stratified_allocation(spark: SparkSession, sf: str) -> DataFrame:
    p = A.flows_processed(spark, sf)
    counts = p.groupBy("source_partition", "target").agg(F.count(F.lit(1)).alias("count"))
    return SA.stratified_allocation(counts, 1000, "target", "count", ["source_partition"])


@register("stratified_sample", FLOW_SQL + _alloc_sql(1000) + """,
ranked_s AS (SELECT p.source_partition, p.row_digest, p.target,
                  row_number() OVER (PARTITION BY p.source_partition, p.target ORDER BY """ + O.seeded_hash_sql(42, "p.row_digest") + """, p.row_digest) AS rn
           FROM processed p)
SELECT r.source_partition, r.row_digest, CAST(r.target AS INTEGER) AS target FROM ranked_s r JOIN alloc a USING (source_partition)
WHERE r.rn <= CASE WHEN r.target = 0 THEN a.quota_0 ELSE a.quota_1 END""")
def q_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    p = A.flows_processed(spark, sf).withColumn("target", F.col("target").cast("int"))
    s = SA.stratified_sample(p, 1000, 42, "row_digest", "target", ["source_partition"])
    return s.select("source_partition", "row_digest", "target")


@register("promotion_slice", FLOW_SQL + """,
v AS (SELECT * FROM processed WHERE source_partition = 'validation'),
cnt AS (SELECT count(*) FILTER (WHERE target = 0) AS c0, count(*) FILTER (WHERE target = 1) AS c1 FROM v),
alloc AS (SELECT *, least(least(c1, greatest(1, CAST(floor(least(2000, c0 + c1) * 0.05) AS BIGINT)),
                      greatest(50, CAST(round_even(least(2000, c0 + c1) * (c1 / (c0 + c1)), 0) AS BIGINT))),
                      least(2000, c0 + c1) - 1) AS q1, least(2000, c0 + c1) AS rows FROM cnt),
ranked_s AS (SELECT v.row_digest, v.target, row_number() OVER (PARTITION BY v.target ORDER BY """ + O.seeded_hash_sql(42, "v.row_digest") + """, v.row_digest) AS rn FROM v)
SELECT r.row_digest, CAST(r.target AS INTEGER) AS target FROM ranked_s r, alloc a
WHERE r.rn <= CASE WHEN r.target = 1 THEN a.q1 ELSE a.rows - a.q1 END""")
def q_promotion_slice(spark: SparkSession, sf: str) -> DataFrame:
    v = A.flows_processed(spark, sf).filter(F.col("source_partition") == "validation").withColumn(
        "target", F.col("target").cast("int"))
    s = SA.promotion_slice(v, 2000, 42, "row_digest", min_positive_rows=50, max_positive_fraction=0.05)
    return s.select("row_digest", "target")


REQUESTS, ATTACK_FRACTION = 20_000, 0.75


def _request_sql() -> str:
    attacks = round(REQUESTS * ATTACK_FRACTION)
    parts = []
    for label, count in ((0, REQUESTS - attacks), (1, attacks)):
        seed = 42 + label
        parts.append(f"""
SELECT row_digest, CAST(target AS INTEGER) AS target, CAST(NULL AS BIGINT) AS draw FROM r{label}, n{label} WHERE n >= {count} AND rn <= {count}
UNION ALL
SELECT row_digest, CAST(target AS INTEGER), id FROM r{label}, n{label},
       (SELECT id, {O.seeded_hash_sql(seed, "id")} AS h FROM (SELECT unnest(range({count})) AS id))
WHERE n < {count} AND rn - 1 = h % n""")
    ctes = "".join(f""",
r{label} AS (SELECT row_digest, target, row_number() OVER (ORDER BY {O.seeded_hash_sql(42 + label, "row_digest")}, row_digest) AS rn
             FROM processed WHERE source_partition = 'reference' AND target = {label}),
n{label} AS (SELECT count(*) AS n FROM r{label})""" for label in (0, 1))
    return O.with_ctes(O.RAW_FLOWS) + ctes + " UNION ALL ".join(parts)


@register("request_sample", _request_sql())
def q_request_sample(spark: SparkSession, sf: str) -> DataFrame:
    """20 000 requests with a 0.75 attack fraction from the reference partition; a class that has fewer
    rows is drawn with replacement."""
    # counts, ranks and draws of both classes read the rows: prepared once
    ref = A.kept_flows(spark, sf).filter(F.col("source_partition") == "reference").withColumn(
        "target", F.col("target").cast("int"))
    s = SA.request_sample(ref, REQUESTS, 42, "row_digest", "target", attack_fraction=ATTACK_FRACTION)
    return s.select("row_digest", "target", "draw")

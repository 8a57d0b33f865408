"""Registered queries: classifier metrics and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import drift as D
from kestrel.operators import metrics as M
from kestrel.plans import adapters as A
from kestrel.plans import oracle as O
from kestrel.plans.registry import register

R6 = 6


def _r(cols):
    return [F.round(F.col(c), R6).alias(c) for c in cols]


_CM_SQL = """
SELECT lang, count(*) AS rows,
       count(*) FILTER (WHERE score >= 0.5 AND target = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND target = 0) AS fp,
       count(*) FILTER (WHERE score < 0.5 AND target = 0) AS tn, count(*) FILTER (WHERE score < 0.5 AND target = 1) AS fn
FROM scored GROUP BY lang"""


@register("confusion_matrix", O.with_ctes(O.SCORED) + _CM_SQL)
def q_confusion(spark: SparkSession, sf: str) -> DataFrame:
    s = A.scored(spark, sf).withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    return M.confusion_matrix(s, "target", "prediction", ["lang"])


_RATES = ("accuracy", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate")


def _zd(n, d):
    return f"COALESCE(({n}) / NULLIF(({d}), 0), 0.0)"


@register("binary_metrics", O.with_ctes(O.SCORED) + f""", cm AS ({_CM_SQL}),
pr AS (SELECT *, {_zd('tp', 'tp + fp')} AS precision, {_zd('tp', 'tp + fn')} AS recall FROM cm)
SELECT lang, rows, tp, fp, tn, fn, round({_zd('tp + tn', 'rows')}, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round({_zd('2 * precision * recall', 'precision + recall')}, 6) AS f1,
       round({_zd('fp', 'fp + tn')}, 6) AS false_positive_rate, round({_zd('fn', 'fn + tp')}, 6) AS false_negative_rate
FROM pr""")
def q_binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = M.binary_metrics(A.scored(spark, sf), "target", "score", ["lang"])
    return m.select("lang", "rows", "tp", "fp", "tn", "fn", *_r(_RATES))


_RANK_SQL = O.with_ctes(O.SCORED) + """,
sc AS (SELECT lang, score, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target = 0) AS neg
       FROM scored GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS cum_tp, sum(neg) OVER w AS cum_fp FROM sc
        WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
rk AS (SELECT lang, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
              CASE WHEN sum(pos) > 0 THEN sum(pos * cum_tp / (cum_tp + cum_fp)) / sum(pos) END AS average_precision,
              CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                   THEN (sum(pos * (neg * 0.5 - cum_fp)) + sum(pos) * sum(neg)) / (sum(pos) * sum(neg)) END AS roc_auc
       FROM cum GROUP BY lang)"""


@register("average_precision", _RANK_SQL + "\nSELECT lang, positives, negatives, round(average_precision, 6) AS average_precision FROM rk")
def q_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    r = M.ranking_metrics(A.scored(spark, sf), "target", "score", ["lang"])
    return r.select("lang", "positives", "negatives", *_r(["average_precision"]))


@register("roc_auc", _RANK_SQL + "\nSELECT lang, positives, negatives, round(roc_auc, 6) AS roc_auc FROM rk")
def q_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    r = M.ranking_metrics(A.scored(spark, sf), "target", "score", ["lang"])
    return r.select("lang", "positives", "negatives", *_r(["roc_auc"]))


@register("cumulative_counts", O.with_ctes(O.SCORED) + """,
sc AS (SELECT lang, score, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target = 0) AS neg
       FROM scored GROUP BY ALL)
SELECT lang, round(score, 6) AS score, pos, neg,
       CAST(sum(pos) OVER w AS BIGINT) AS cum_tp, CAST(sum(neg) OVER w AS BIGINT) AS cum_fp
FROM sc WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def q_cumulative_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = M.cumulative_counts(A.scored(spark, sf), "target", "score", ["lang"])
    return c.select("lang", F.round("score", R6).alias("score"), "pos", "neg",
                    F.col("cum_tp").cast("bigint").alias("cum_tp"), F.col("cum_fp").cast("bigint").alias("cum_fp"))


_LP_SQL = O.with_ctes(O.PREDICTIONS) + """,
agg AS (
  SELECT model_version, count(ground_truth) AS labelled_rows,
         count(*) FILTER (WHERE ground_truth = 1) AS true_attack, count(*) FILTER (WHERE ground_truth = 0) AS true_benign,
         count(*) FILTER (WHERE prediction = 'ATTACK' AND ground_truth = 1) AS tp,
         count(*) FILTER (WHERE prediction = 'BENIGN' AND ground_truth = 1) AS fn,
         count(*) FILTER (WHERE prediction = 'ATTACK' AND ground_truth = 0) AS fp,
         count(*) FILTER (WHERE prediction = 'BENIGN' AND ground_truth = 0) AS tn
  FROM predictions GROUP BY model_version),
g AS (SELECT *, list_filter([CASE WHEN labelled_rows < {min_rows} THEN 'minimum_labelled_rows' END,
                             CASE WHEN true_attack < 1 THEN 'min_attack_support' END,
                             CASE WHEN true_benign < 1 THEN 'min_benign_support' END], lambda r: r IS NOT NULL) AS reasons,
             tp / NULLIF(tp + fn, 0) AS rec, tp / NULLIF(tp + fp, 0) AS prec FROM agg)
SELECT model_version, CASE WHEN len(reasons) = 0 THEN 'available' ELSE 'insufficient_labels' END AS status,
       labelled_rows, true_attack, true_benign, array_to_string(reasons, ',') AS insufficient_reasons,
       CASE WHEN len(reasons) = 0 THEN tp END AS tp, CASE WHEN len(reasons) = 0 THEN fn END AS fn,
       CASE WHEN len(reasons) = 0 THEN fp END AS fp, CASE WHEN len(reasons) = 0 THEN tn END AS tn,
       CASE WHEN len(reasons) = 0 THEN round(rec, 6) END AS attack_recall,
       CASE WHEN len(reasons) = 0 THEN round(prec, 6) END AS precision,
       CASE WHEN len(reasons) = 0 THEN round(CASE WHEN prec IS NULL OR rec IS NULL THEN NULL WHEN prec + rec = 0 THEN 0.0
                                          ELSE 2 * prec * rec / (prec + rec) END, 6) END AS f1,
       CASE WHEN len(reasons) = 0 THEN round(fp / NULLIF(fp + tn, 0), 6) END AS false_positive_rate,
       CASE WHEN len(reasons) = 0 THEN round((tp + tn) / NULLIF(labelled_rows, 0), 6) END AS accuracy
FROM g"""


@register("labelled_performance", _LP_SQL.replace("{min_rows}", "20"))
def q_labelled_performance(spark: SparkSession, sf: str) -> DataFrame:
    p = M.labelled_performance(A.predictions(spark, sf), by=["model_version"])
    return p.select("model_version", "status", "labelled_rows", "true_attack", "true_benign",
                    F.array_join("insufficient_reasons", ",").alias("insufficient_reasons"), "tp", "fn", "fp", "tn",
                    *_r(["attack_recall", "precision", "f1", "false_positive_rate", "accuracy"]))


@register("prediction_distribution", O.with_ctes(O.PREDICTIONS) + """
SELECT model_version, count(*) FILTER (WHERE prediction <> 'ATTACK') AS benign_count,
       count(*) FILTER (WHERE prediction = 'ATTACK') AS attack_count, count(*) AS total,
       round(count(*) FILTER (WHERE prediction <> 'ATTACK') / count(*), 6) AS benign_share,
       round(count(*) FILTER (WHERE prediction = 'ATTACK') / count(*), 6) AS attack_share
FROM predictions GROUP BY model_version""")
def q_prediction_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = M.prediction_distribution(A.predictions(spark, sf), by=["model_version"])
    return d.select("model_version", "benign_count", "attack_count", "total", *_r(["benign_share", "attack_share"]))


@register("true_label_distribution", O.with_ctes(O.PREDICTIONS) + """
SELECT strftime("timestamp", '%Y-%m-%d') AS day,
       CASE WHEN count(ground_truth) > 0 THEN count(*) FILTER (WHERE ground_truth = 0) END AS benign_count,
       CASE WHEN count(ground_truth) > 0 THEN count(*) FILTER (WHERE ground_truth = 1) END AS attack_count,
       CASE WHEN count(ground_truth) > 0 THEN count(ground_truth) END AS total,
       round(count(*) FILTER (WHERE ground_truth = 0) / NULLIF(count(ground_truth), 0), 6) AS benign_share,
       round(count(*) FILTER (WHERE ground_truth = 1) / NULLIF(count(ground_truth), 0), 6) AS attack_share
FROM predictions GROUP BY ALL""")
def q_true_label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    p = A.predictions(spark, sf).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    d = M.true_label_distribution(p, by=["day"])
    return d.select("day", "benign_count", "attack_count", "total", *_r(["benign_share", "attack_share"]))


@register("model_version_distribution", O.with_ctes(O.PREDICTIONS) + """
SELECT strftime("timestamp", '%Y-%m-%d') AS day, model_version, count(*) AS rows
FROM predictions GROUP BY ALL""")
def q_model_version_distribution(spark: SparkSession, sf: str) -> DataFrame:
    p = A.predictions(spark, sf).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    return M.model_version_distribution(p, by=["day"])


# ---- drift ---------------------------------------------------------------------------------------
def _drift_tall(spark, sf):
    w = A.drift_windows(spark, sf)
    return D.unpivot(w, A.WINDOW_FEATURES, ["side"])


def _psi(spark, sf):
    t = _drift_tall(spark, sf)
    ref = t.filter(F.col("side") == "reference").drop("side")
    cur = t.filter(F.col("side") == "current").drop("side")
    return D.psi(ref, cur)


_PSI_SQL = O.with_ctes(O.DRIFT_WINDOWS) + """,
ref_side AS (SELECT feature, x FROM drift_tall WHERE side = 'reference'),
cur_side AS (SELECT feature, x FROM drift_tall WHERE side = 'current'),""" + O.psi_sql("ref_side", "cur_side")


@register("psi", _PSI_SQL + "\nSELECT feature, n_ref, n_cur, round(psi, 9) AS psi FROM psi_out")
def q_psi(spark: SparkSession, sf: str) -> DataFrame:
    return _psi(spark, sf).select("feature", "n_ref", "n_cur", F.round("psi", 9).alias("psi"))


@register("drift_summary", _PSI_SQL + """
SELECT count(*) AS monitored_feature_count, count(*) FILTER (WHERE psi >= 0.2) AS drifting_feature_count,
       array_to_string(list_sort(list(feature) FILTER (WHERE psi >= 0.2)), ',') AS drifting_features,
       round(count(*) FILTER (WHERE psi >= 0.2) / count(*), 6) AS drift_share,
       count(*) FILTER (WHERE psi >= 0.2) / count(*) >= 0.3 AS data_drift_detected
FROM psi_out""")
def q_drift_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = D.drift_summary(_psi(spark, sf), psi_threshold=0.2, share_threshold=0.3)
    return s.select("monitored_feature_count", "drifting_feature_count",
                    F.array_join("drifting_features", ",").alias("drifting_features"),
                    F.round("drift_share", R6).alias("drift_share"), "data_drift_detected")


@register("zero_variance", O.with_ctes(O.DRIFT_WINDOWS) + """
SELECT side, feature,
       min(x) FILTER (WHERE x IS NOT NULL AND NOT isnan(x) AND abs(x) < 'Infinity'::DOUBLE) IS NULL
       OR min(x) FILTER (WHERE x IS NOT NULL AND NOT isnan(x) AND abs(x) < 'Infinity'::DOUBLE)
          = max(x) FILTER (WHERE x IS NOT NULL AND NOT isnan(x) AND abs(x) < 'Infinity'::DOUBLE) AS zero_variance
FROM drift_tall GROUP BY ALL""")
def q_zero_variance(spark: SparkSession, sf: str) -> DataFrame:
    return D.zero_variance(_drift_tall(spark, sf), ["side", "feature"])

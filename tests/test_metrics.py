import math

from pyspark.sql import functions as F

from kestrel.operators import metrics as M


def test_confusion_and_rates_f4(spark):
    df = spark.createDataFrame([(0.1, 0), (0.8, 0), (0.7, 1), (0.2, 1)], "score double, target int")
    r = M.binary_metrics(df, "target", "score").first()
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 1, 1, 1)
    assert r.recall == 0.5 and r.false_positive_rate == 0.5 and r.false_negative_rate == 0.5


def _brute(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        tp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 1)
        fp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 0)
        r = tp / len(pos)
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap, auc


def test_ap_auc_match_brute_force_with_ties(spark):
    scores = [0.1, 0.4, 0.35, 0.8, 0.4, 0.4, 0.9, 0.05, 0.35, 0.6]
    labels = [0, 0, 1, 1, 1, 0, 1, 0, 0, 1]
    df = spark.createDataFrame(list(zip(scores, labels)), "score double, target int")
    r = M.ranking_metrics(df, "target", "score").first()
    ap, auc = _brute(scores, labels)
    assert math.isclose(r.average_precision, ap, rel_tol=1e-12)
    assert math.isclose(r.roc_auc, auc, rel_tol=1e-12)


def test_roc_auc_null_with_one_class(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, target int")
    assert M.ranking_metrics(df, "target", "score").first().roc_auc is None


def test_labelled_performance_f8(spark):
    rows = [("ATTACK", 1), ("BENIGN", 1), ("ATTACK", 0), ("BENIGN", 0)]
    df = spark.createDataFrame(rows, "prediction string, ground_truth int")
    r = M.labelled_performance(df, minimum_labelled_rows=2).first()
    assert r.status == "available"
    assert (r.attack_recall, r.precision, r.f1) == (0.5, 0.5, 0.5)
    one = spark.createDataFrame([("BENIGN", 0)], "prediction string, ground_truth int")
    r2 = M.labelled_performance(one, minimum_labelled_rows=2).first()
    assert r2.status == "insufficient_labels" and r2.attack_recall is None and r2.f1 is None


def test_unknown_prediction_strings_stay_in_accuracy_denominator(spark):
    df = spark.createDataFrame([("ATTACK", 1), ("??", 0)], "prediction string, ground_truth int")
    r = M.labelled_performance(df, minimum_labelled_rows=1).first()
    assert r.accuracy == 0.5 and r.tn == 0


def test_running_totals_match_window(spark):
    from pyspark.sql import Window

    from kestrel.operators.ranking import running_totals

    df = spark.range(0, 500).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 101).alias("x")).groupBy(
        "g", "x").agg(F.count(F.lit(1)).alias("w"))
    got = running_totals(df, ["g"], "x", ["w"], buckets=8)
    w = Window.partitionBy("g").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("cum_w", F.sum("w").over(w))
    assert sorted(got.collect()) == sorted(want.collect())

import math

from pyspark.sql import functions as F

from kestrel.operators import drift as D


def _tall(spark, values, feature="a"):
    return spark.createDataFrame([(feature, float(v)) for v in values], "feature string, x double")


def test_psi_golden_values_f7(spark):
    ref = _tall(spark, range(100))
    same = D.psi(ref, _tall(spark, range(100))).first().psi
    far = D.psi(ref, _tall(spark, range(1000, 1100))).first().psi
    assert same == 0.0
    assert math.isclose(far, 12.433855885838662, rel_tol=1e-12)
    half = D.psi(_tall(spark, range(50)), _tall(spark, range(100, 150))).first().psi
    assert math.isclose(half, 12.433855885838662, rel_tol=1e-12)


def test_psi_constant_reference_and_empty_side(spark):
    assert D.psi(_tall(spark, [5.0] * 10), _tall(spark, [5.0] * 3)).first().psi == 0.0
    assert D.psi(_tall(spark, [1.0] * 10), _tall(spark, [2.0] * 3)).first().psi == 1.0
    empty_cur = spark.createDataFrame([], "feature string, x double")
    assert D.psi(_tall(spark, range(10)), empty_cur).first().psi == float("inf")
    nonfinite = _tall(spark, [float("nan"), float("inf")])
    assert D.psi(_tall(spark, range(10)), nonfinite).first().psi == float("inf")


def _psi_numpy(ref, cur, bins=10):
    import numpy as np

    ref, cur = np.array(ref), np.array(cur)
    edges = np.unique(np.quantile(ref, np.arange(bins + 1) / bins))
    if len(edges) < 3:
        m = min(bins, len(ref))
        edges = np.array([ref.min() + j * ((ref.max() - ref.min()) / m) for j in range(m + 1)])
    inner = edges[1:-1]
    r, c = (np.bincount(np.searchsorted(inner, v, "right"), minlength=len(inner) + 1) / len(v) for v in (ref, cur))
    used = (r > 0) | (c > 0)
    r, c = np.maximum(r[used], 1e-6), np.maximum(c[used], 1e-6)
    return float(((c - r) * np.log(c / r)).sum())


def test_psi_equals_numpy_on_all_kinds_of_values(spark):
    import random

    r = random.Random(4)
    kinds = {"wide": lambda: r.gauss(0, 1e6), "ties": lambda: float(r.randint(0, 4)), "two": lambda: float(r.random() < 0.02),
             "hot": lambda: 7.0 if r.random() < 0.4 else r.random() * 20, "log": lambda: 10 ** r.uniform(-8, 8)}
    rows = {k: ([f() for _ in range(30_000)], [f() * 1.1 for _ in range(9_000)]) for k, f in kinds.items()}
    side = lambda i: spark.createDataFrame([(k, x) for k, v in rows.items() for x in v[i]], "feature string, x double")
    got = {q["feature"]: q["psi"] for q in D.psi(side(0).repartition(7), side(1).repartition(5)).collect()}
    for k, (a, b) in rows.items():
        assert math.isclose(got[k], _psi_numpy(a, b), rel_tol=1e-9), k


def test_brackets_that_miss_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(D, "RANK_ERROR", 0.001)
    monkeypatch.setattr(D, "SKETCH_SIZE", 8)
    import random

    r = random.Random(5)
    a, b = [r.random() for _ in range(20_000)], [r.random() ** 1.2 for _ in range(5_000)]
    got = D.psi(_tall(spark, a), _tall(spark, b)).first()["psi"]
    assert math.isclose(got, _psi_numpy(a, b), rel_tol=1e-9)


def test_exact_quantiles_match_numpy_linear(spark):
    import numpy as np

    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0]
    q = D.exact_quantiles(_tall(spark, vals), ["feature"]).orderBy("p").collect()
    expected = np.quantile(np.array(vals), [r.p for r in q])
    assert all(math.isclose(r.q, e, rel_tol=1e-12) for r, e in zip(q, expected))


def test_drift_summary_share_f7(spark):
    ref = spark.createDataFrame([("a", float(i)) for i in range(50)] + [("b", float(i)) for i in range(50)] +
                                [("c", 1.0)] * 50, "feature string, x double")
    cur = spark.createDataFrame([("a", float(i)) for i in range(100, 150)] + [("b", float(i)) for i in range(50)] +
                                [("c", 1.0)] * 50, "feature string, x double")
    s = D.drift_summary(D.psi(ref, cur), psi_threshold=0.1, share_threshold=0.34).first()
    assert s.drifting_feature_count == 1 and s.monitored_feature_count == 3
    assert not s.data_drift_detected


def test_zero_variance(spark):
    t = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", float("nan"))], "feature string, x double")
    got = {r.feature: r.zero_variance for r in D.zero_variance(t).collect()}
    assert got == {"a": True, "b": False, "c": True}

"""Models are fitted to the whole train partition, and their thresholds to every row of it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kestrel.operators import ml as ML
from kestrel.plans import adapters as A
from kestrel.plans import q_ml

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query, fits", [("feature_importance", 1), ("fit_gbt", 1), ("param_search", 4), ("refit_winner", 5)])
def test_every_train_row_is_fitted(spark, monkeypatch, query, fits):
    seen = []

    def counted(family, train, *args, **kwargs):
        seen.append(sorted(r["row_digest"] for r in train.select("row_digest").collect()))
        return ML.fit_logistic(train, q_ml.FEATS, max_iter=2)

    monkeypatch.setattr(q_ml, "TRAIN_ROWS", 50)
    monkeypatch.setattr(ML, "fit_family", counted)
    assert getattr(q_ml, f"q_{query}")(spark, SF).count() > 0
    rows = A.flows_processed(spark, SF).where(F.col("source_partition") == "train").select("row_digest").collect()
    want = sorted(r["row_digest"] for r in rows)
    assert len(want) > 50 and seen == [want] * fits


def test_thresholds_come_from_every_row(spark):
    """100 values change class every 7: MLlib's 32 bins of 10 000 rows lack some of these thresholds."""
    value = F.col("id") % 100
    rows = spark.range(12_800).select(value.cast("double").alias("x"), (F.floor(value / 7) % 2).cast("int").alias("target"))
    forest = ML.fit_forest(rows, ["x"], num_trees=3, max_depth=15, min_instances=1, max_features="all")
    assert forest.transform(rows).where(F.col("prediction") != F.col("target")).count() == 0
    for n in (10_001, 99_645, 36_000_000):
        assert ML.split_bins(n) ** 2 >= n
    assert ML.split_bins(10_000) == 32

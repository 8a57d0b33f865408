"""A record's payload is parsed once, whatever is asked of the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators.serving import validate_features


def test_filters_stay_above_the_parse(spark):
    rows = spark.range(3).select("id", F.when(F.col("id") == 1, '{"value": 1.5, "k": 2}').when(F.col("id") == 2, '{"value": NaN, "k": 2}')
                                 .otherwise("{not-json").alias("p"))
    v = validate_features(rows, "p", ["value", "k"]).where(
        F.col("features_typed")["value"].isNotNull() & (F.col("validation_category") == "valid") & (F.col("id") > 0))
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 2, plan   # the call and its name at most
    assert [r["id"] for r in v.collect()] == [1]

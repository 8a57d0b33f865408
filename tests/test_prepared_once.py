"""Fits, searches and request draws read prepared flows, not the raw table again and again."""

from __future__ import annotations

from kestrel.plans import adapters as A
from kestrel.plans.q_ml import _parts

SF = "/root/testdata/sf0.001"


def test_evaluation_reads_prepared_flows(spark):
    _, valid, test = _parts(spark, SF)
    for part in (valid, test):
        assert part.inputFiles() and not any("lineitem" in f for f in part.inputFiles())


def test_prepared_flows_are_all_of_them(spark):
    columns = ["row_digest", "target", *A.FLOW_FEATURES, "source_partition"]
    want = A.flows_processed(spark, SF).select(*columns).collect()
    assert want and sorted(map(tuple, A.kept_flows(spark, SF).select(*columns).collect())) == sorted(map(tuple, want))

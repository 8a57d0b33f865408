"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import written


def components(edges: DataFrame, name: str) -> DataFrame:
    """(v, comp) for every vertex of ``edges`` (a long, b long); comp is the component's least vertex.

    Each round a vertex takes the least label among its neighbours and itself, then its label's
    label. Rounds end when no label changes: every round is written to the shared folder, so
    neither lineage nor driver state grows."""
    both = written(edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
                   .union(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct(), f"{name}-edges")
    labels = written(both.groupBy("v").agg(F.min("u").alias("m"))
                     .select("v", F.least("v", "m").alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = (both.join(labels.select(F.col("v").alias("u"), F.col("comp").alias("c")), "u")
                .groupBy("v").agg(F.min("c").alias("c")))
        new = (labels.join(near, "v").select("v", F.col("comp").alias("old"), F.least("comp", "c").alias("c")))
        jump = labels.select(F.col("v").alias("c"), F.col("comp").alias("cc"))
        labels_next = written(new.join(jump, "c").select("v", "old", F.least("c", "cc").alias("comp")), f"{name}-{step}")
        changed = labels_next.where("old <> comp").limit(1).count()
        labels = labels_next.select("v", "comp")
        if not changed:
            return labels

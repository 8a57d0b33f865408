"""Running totals over an ordered key without a single-partition window.

``running_totals`` gives, for each distinct (group, order value) row, the inclusive
running sum of measures in ascending or descending order. A global window would
pull every row of a group into one task; instead the ordered domain is cut into
``buckets`` ranges (approximate quantiles of the distinct values), the per-bucket
totals form a small table whose prefix sums are the offsets, and the exact running
sum is finished inside each (group, bucket) partition. Exact for any data; the
buckets only balance the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, keys: Sequence[str], order_col: str, measures: Sequence[str],
                   descending: bool = False, buckets: int = 64, prefix: str = "cum_") -> DataFrame:
    """``df`` must hold one row per (keys, order_col). Adds ``{prefix}{m}`` columns (inclusive)."""
    keys = list(keys)
    probs = [i / buckets for i in range(1, buckets)]
    x = F.col(order_col).cast("double")
    if not keys:
        # one group: the bucket bounds are a short literal array held by the driver
        row = df.agg(F.percentile_approx(x, F.lit(probs), F.lit(10000)).alias("b")).first()
        bounds_lit = F.array(*[F.lit(float(v)) for v in (row["b"] or [])]).cast("array<double>")
        staged = df.withColumn("_bkt", F.size(F.filter(bounds_lit, lambda b: b <= x)))
    else:
        bounds = df.groupBy(*keys).agg(F.percentile_approx(x, F.lit(probs), F.lit(10000)).alias("_bounds"))
        bucket = F.size(F.filter(F.col("_bounds"), lambda b: b <= x))
        staged = df.join(bounds, keys, "left").withColumn("_bkt", F.coalesce(bucket, F.lit(0))).drop("_bounds")
    totals = staged.groupBy(*keys, "_bkt").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    bo = F.col("_bkt").desc() if descending else F.col("_bkt").asc()
    # the bucket table is small (groups x buckets); an un-keyed window over it is bounded
    wb = (Window.partitionBy(*keys) if keys else Window).orderBy(bo).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bkt", *[F.coalesce(F.sum(f"_t_{m}").over(wb), F.lit(0)).alias(f"_o_{m}")
                                             for m in measures])
    xo = F.col(order_col).desc() if descending else F.col(order_col).asc()
    wi = Window.partitionBy(*keys, "_bkt").orderBy(xo).rowsBetween(Window.unboundedPreceding, 0)
    out = staged.join(offsets, [*keys, "_bkt"], "left")
    for m in measures:
        out = out.withColumn(f"{prefix}{m}", F.col(f"_o_{m}") + F.sum(m).over(wi))
    return out.drop("_bkt", *[f"_o_{m}" for m in measures])

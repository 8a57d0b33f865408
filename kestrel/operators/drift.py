"""Population stability index, zero-variance features and the drift summary.

Inputs are tall frames ``(feature, x)`` (see ``unpivot``), optionally with extra
group keys (e.g. one current window per day). Quantile edges come from a mergeable
quantile sketch that brackets each decile and an exact count inside the brackets,
never from a per-group buffer of all values.

PSI recipe per feature: finite values only; an empty side gives +inf; a constant
reference gives 0.0 when the current side is the same constant, else 1.0; edges are
the distinct exact deciles of the reference (linear interpolation); fewer than
three edges fall back to min(10, n_ref) equal-width bins over [min, max]; outer
edges open to -inf / +inf; bins are [e_i, e_i+1); proportions floored at 1e-6;
PSI = sum((c - r) * ln(c / r)).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import is_finite
from kestrel.operators.ranking import running_totals
from kestrel.session import materialize

EPSILON = 1e-6
DECILES = [i / 10 for i in range(11)]


def unpivot(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Wide features -> tall (keys..., feature, x double)."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features])
    return wide.unpivot(list(keys), list(features), "feature", "x")


def exact_quantiles(tall: DataFrame, keys: Sequence[str], probs: Sequence[float] = DECILES) -> DataFrame:
    return weighted_quantiles(tall.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("w")), keys, probs)


def value_counts(tall: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Finite values only, one row per distinct (keys, x) with its multiplicity ``w``."""
    return tall.filter(is_finite("x")).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("w"))


def weighted_quantiles(d: DataFrame, keys: Sequence[str], probs: Sequence[float] = DECILES, flag: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles from distinct value counts ``d`` (keys..., x, w). With
    ``flag``, a boolean column of ``d``: whether it holds for the values each quantile comes from."""
    keys = list(keys)
    ok = F.col(flag) if flag else F.lit(True)
    r = running_totals(d, keys, "x", ["w"]).select(
        *keys, "x", ok.alias("ok"), (F.col("cum_w") - F.col("w")).alias("r_start"), (F.col("cum_w") - 1).alias("r_end"))
    n = d.groupBy(*keys).agg(F.sum("w").alias("n"))
    p_arr = F.array(*[F.lit(float(p)) for p in probs])
    targets = (n.select(*keys, "n", F.explode(p_arr).alias("p"))
               .withColumn("pos", F.col("p") * (F.col("n") - 1))
               .withColumn("lo", F.floor("pos")).withColumn("hi", F.ceil("pos")))
    side = targets.select(*keys, "p", "pos", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("rank"))
    s_, r_ = side.alias("s"), r.alias("r")
    cond = [F.col(f"s.{k}") == F.col(f"r.{k}") for k in keys] + [
        F.col("s.rank") >= F.col("r.r_start"), F.col("s.rank") <= F.col("r.r_end")]
    located = s_.join(r_, cond, "inner").select(*[F.col(f"s.{k}").alias(k) for k in keys], "s.p", "s.pos", "s.lo",
                                                "s.hi", "s.rank", F.col("r.x").alias("x"), F.col("r.ok").alias("ok"))
    piv = located.groupBy(*keys, "p", "pos", "lo", "hi").agg(
        F.max(F.when(F.col("rank") == F.col("lo"), F.col("x"))).alias("v_lo"),
        F.max(F.when(F.col("rank") == F.col("hi"), F.col("x"))).alias("v_hi"), F.bool_and("ok").alias("ok"))
    q = (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("pos") - F.col("lo"))).alias("q")
    return piv.select(*keys, "p", q, *([F.col("ok").alias(flag)] if flag else []))


#: Size of the quantile sketch, and a bound of its error in ranks that a bracket allows for (a bracket
#: that misses its ranks all the same is noticed, and the exact counts of all values are taken).
SKETCH_SIZE, RANK_ERROR = 2048, 0.005
MOST_KEYS = 10_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as the broadcast side of a join where its known number of rows allows it."""
    return F.broadcast(df) if rows <= MOST_KEYS else df


def reference_sketch(ref_tall: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """First pass over the reference, one row per feature: count, extremes, equal-width edges, and for
    each decile the values between which its order statistics lie (``below`` and ``above``)."""
    n = F.col("n_ref")
    sums = ref_tall.filter(is_finite("x")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_ref"), F.min("x").alias("ref_min"), F.max("x").alias("ref_max"),
        F.kll_sketch_agg_double("x", F.lit(SKETCH_SIZE)).alias("sketch"))
    # ranks of the order statistics are within 2 / n of the decile: part of RANK_ERROR, but for few values
    few = n < 4 / max(RANK_ERROR, 1e-9)
    at = [F.array(*[F.lit(min(max(i / bins + e, 0.0), 1.0)) for i in range(bins + 1)]) for e in (-RANK_ERROR, RANK_ERROR)]
    below, above = (F.when(few, F.array_repeat(edge, bins + 1)).otherwise(F.kll_sketch_get_quantile_double("sketch", r))
                    for edge, r in zip(("ref_min", "ref_max"), at))
    m = F.least(F.lit(bins), n)
    equal = F.transform(F.sequence(F.lit(1), F.greatest(m - 1, F.lit(1))),
                        lambda j: F.col("ref_min") + j * ((F.col("ref_max") - F.col("ref_min")) / m))
    return materialize(sums.select(
        *keys, "n_ref", "ref_min", "ref_max",
        F.when(m > 1, equal).otherwise(F.array().cast("array<double>")).alias("equal_edges"),
        below.alias("below"), above.alias("above")))


def bracketed_counts(ref_tall: DataFrame, sketch: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Second pass over the reference: each value inside a bracket with its count, and one row per stretch
    between brackets and equal-width edges, under its least value (``single`` is false there)."""
    x = F.col("x")
    side = sketch.select(*keys, "below", "above", "equal_edges")
    fin = ref_tall.filter(is_finite("x")).join(small_side(side, rows), keys)
    inside = F.exists(F.arrays_zip("below", "above"), lambda b: (b["below"] <= x) & (x <= b["above"]))
    placed = fin.select(*keys, "x", F.when(inside, x).alias("single_x"),
                        F.size(F.filter("above", lambda h: h < x)).alias("past"),
                        F.size(F.filter("equal_edges", lambda e: e <= x)).alias("step"))
    counts = placed.groupBy(*keys, "single_x", "past", "step").agg(F.count(F.lit(1)).alias("w"), F.min("x").alias("x"))
    return materialize(counts.select(*keys, "x", F.col("single_x").isNotNull().alias("single"), "w"))


def reference_edges(ref_tall: DataFrame, keys: Sequence[str] = ("feature",), bins: int = 10) -> tuple[DataFrame, DataFrame, int]:
    """(edges, counts, features): inner bin edges per feature with n_ref, ref_min and ref_max, and value
    counts of the reference from which its bins are summed. Two passes over the reference."""
    keys = list(keys)
    sketch = reference_sketch(ref_tall, keys, bins)
    rows = sketch.count()
    counts = bracketed_counts(ref_tall, sketch, keys, rows)
    probs = [i / bins for i in range(bins + 1)]
    q = materialize(weighted_quantiles(counts, keys, probs, flag="single"))
    if not q.where(~F.col("single")).isEmpty():
        counts = materialize(value_counts(ref_tall, keys))
        q = weighted_quantiles(counts, keys, probs)
    edges = q.groupBy(*keys).agg(F.array_distinct(F.array_sort(F.collect_list("q"))).alias("q_edges"))
    inner = F.when(F.size("q_edges") < 3, F.col("equal_edges")).otherwise(F.slice("q_edges", 2, F.size("q_edges") - 2))
    out = sketch.join(edges, keys, "left").select(*keys, "n_ref", "ref_min", "ref_max", inner.alias("inner_edges"))
    return materialize(out), counts, rows


def psi(ref_tall: DataFrame, cur_tall: DataFrame, keys: Sequence[str] = ("feature",),
        cur_keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """PSI per feature (and per extra current-side group ``cur_keys``, e.g. a window id).

    ``ref_tall``: (keys..., x); ``cur_tall``: (cur_keys..., keys..., x). The reference is read twice (a
    mergeable quantile sketch, then exact counts inside its brackets), the current side once (counts
    per bin); everything after that works on the small results, which are written down.
    Returns (cur_keys..., keys..., n_ref, n_cur, psi).
    """
    keys, cur_keys = list(keys), list(cur_keys)
    edges, dref, features = reference_edges(ref_tall, keys, bins)
    x = F.col("x")
    bucket = F.coalesce(F.size(F.filter(F.col("inner_edges"), lambda e: e <= x)), F.lit(-1))
    ie = small_side(edges.select(*keys, "inner_edges"), features)
    ref_b = dref.join(ie, keys).groupBy(*keys, bucket.alias("b")).agg(F.sum("w").alias("rc"))
    cur_b = materialize(cur_tall.filter(is_finite("x")).join(ie, keys, "left").groupBy(*cur_keys, *keys, bucket.alias("b")).agg(
        F.count(F.lit(1)).alias("cc"), F.min("x").alias("cur_min"), F.max("x").alias("cur_max")))
    cur_stats = cur_b.groupBy(*cur_keys, *keys).agg(F.sum("cc").alias("n_cur"), F.min("cur_min").alias("cur_min"),
                                                    F.max("cur_max").alias("cur_max"))
    cur_b = cur_b.select(*cur_keys, *keys, "b", "cc")
    groups = cur_stats.join(edges.select(*keys, "n_ref", "ref_min", "ref_max"), keys, "full")
    grid = groups.select(*cur_keys, *keys).join(ref_b, keys, "left").select(*cur_keys, *keys, "b", "rc")
    both = grid.join(cur_b, [*cur_keys, *keys, "b"], "full").select(
        *cur_keys, *keys, F.coalesce("rc", F.lit(0)).alias("rc"), F.coalesce("cc", F.lit(0)).alias("cc"))
    term = both.join(groups.select(*cur_keys, *keys, "n_ref", "n_cur"), [*cur_keys, *keys], "inner").select(
        *cur_keys, *keys,
        F.greatest(F.col("rc") / F.col("n_ref"), F.lit(EPSILON)).alias("r"),
        F.greatest(F.col("cc") / F.col("n_cur"), F.lit(EPSILON)).alias("c"))
    sums = term.groupBy(*cur_keys, *keys).agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("s"))
    out = groups.join(sums, [*cur_keys, *keys], "left")
    n_ref, n_cur = F.coalesce("n_ref", F.lit(0)), F.coalesce("n_cur", F.lit(0))
    value = (F.when((n_ref == 0) | (n_cur == 0), F.lit(float("inf")))
             .when(F.col("ref_min") == F.col("ref_max"),
                   F.when((F.col("cur_min") == F.col("cur_max")) & (F.col("cur_min") == F.col("ref_min")), F.lit(0.0))
                   .otherwise(F.lit(1.0)))
             .otherwise(F.col("s")))
    return out.select(*cur_keys, *keys, n_ref.cast("bigint").alias("n_ref"), n_cur.cast("bigint").alias("n_cur"),
                      value.alias("psi"))


def zero_variance(tall: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Features with at most one distinct finite value (min = max, or no finite value at all)."""
    fin = F.when(is_finite("x"), F.col("x"))
    agg = tall.groupBy(*keys).agg(F.min(fin).alias("lo"), F.max(fin).alias("hi"))
    return agg.select(*keys, (F.col("lo").isNull() | (F.col("lo") == F.col("hi"))).alias("zero_variance"))


def drift_summary(psi_df: DataFrame, by: Sequence[str] = (), psi_threshold: float = 0.2,
                  share_threshold: float = 0.3) -> DataFrame:
    """drifting = PSI >= threshold; share over monitored features; detected if share >= threshold."""
    drifting = F.col("psi") >= psi_threshold
    agg = psi_df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("monitored_feature_count"),
        F.count_if(drifting).alias("drifting_feature_count"),
        F.array_sort(F.collect_list(F.when(drifting, F.col("feature")))).alias("drifting_features"))
    share = F.when(F.col("monitored_feature_count") > 0,
                   F.col("drifting_feature_count") / F.col("monitored_feature_count")).otherwise(F.lit(0.0))
    return agg.select("*", share.alias("drift_share"), (share >= share_threshold).alias("data_drift_detected"))

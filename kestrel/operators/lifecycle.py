"""Model lifecycle decisions as table operators: thresholds, gates, composite score,
promotion, state from an event log, rollback eligibility and registrations.

Metric tables are tall: (model_version, metric, value). Policies are small config
tables (one row per gate / weight) joined by metric name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: default gate policy and composite weights (equal the reference's) ---------
FIXED_GATE_POLICY = (
    # gate, source_metric, direction, fraction_of_baseline, multiplier_of_baseline, minimum_ceiling
    ("pr_auc", "pr_auc", "min", 0.90, None, None),
    ("attack_recall", "attack_class_recall", "min", 0.90, None, None),
    ("f1", "f1", "min", 0.90, None, None),
    ("false_positive_rate", "false_positive_rate", "max", None, 5.0, 0.001),
    ("inference_latency_ms_per_row", "inference_latency_ms_per_row", "max", None, 20.0, 0.01),
)
FIXED_COMPOSITE_WEIGHTS = (("pr_auc", 0.30), ("attack_recall", 0.30), ("f1", 0.20), ("false_positive_rate", 0.10),
                           ("inference_latency_ms_per_row", 0.10))
MINIMUM_RELATIVE_IMPROVEMENT = 0.01
# ------------------------------------------------------------------------------------------------

POLICY_SCHEMA = ("gate string, source_metric string, direction string, fraction double, multiplier double, "
                 "ceiling double")


def policy_table(spark: SparkSession, policy=FIXED_GATE_POLICY) -> DataFrame:
    return spark.createDataFrame(list(policy), POLICY_SCHEMA)


def weights_table(spark: SparkSession, weights=FIXED_COMPOSITE_WEIGHTS) -> DataFrame:
    return spark.createDataFrame(list(weights), "gate string, weight double")


def derive_thresholds(baseline: DataFrame, policy: DataFrame) -> DataFrame:
    """min gates: baseline * fraction; max gates: max(baseline * multiplier, floor); with formula text.
    ``baseline``: (metric, value) of the baseline model."""
    j = policy.join(F.broadcast(baseline.withColumnRenamed("metric", "source_metric")), "source_metric", "left")
    thr = F.when(F.col("direction") == "min", F.col("value") * F.col("fraction")).otherwise(
        F.greatest(F.col("value") * F.col("multiplier"), F.coalesce("ceiling", F.lit(0.0))))
    formula = F.when(F.col("direction") == "min",
                     F.concat(F.col("source_metric"), F.lit(" * "), F.col("fraction").cast("string"))).otherwise(
        F.concat(F.lit("max("), F.col("source_metric"), F.lit(" * "), F.col("multiplier").cast("string"), F.lit(", "),
                 F.coalesce("ceiling", F.lit(0.0)).cast("string"), F.lit(")")))
    return j.select("gate", "source_metric", "direction", F.col("value").alias("baseline"), thr.alias("threshold"),
                    formula.alias("formula"))


def evaluate_gates(candidates: DataFrame, thresholds: DataFrame, key: str = "model_version") -> DataFrame:
    """Per candidate and gate: >= for min gates, <= for max gates (gates_join)."""
    t = thresholds.select("gate", "source_metric", "direction", "threshold")
    j = candidates.withColumnRenamed("metric", "source_metric").join(F.broadcast(t), "source_metric")
    passed = F.when(F.col("direction") == "min", F.col("value") >= F.col("threshold")).otherwise(
        F.col("value") <= F.col("threshold"))
    return j.select(key, "gate", F.col("value").alias("candidate"), "threshold", passed.alias("passed"),
                    F.when(F.col("direction") == "min", F.lit(">=")).otherwise(F.lit("<=")).alias("operator"))


def gate_summary(gates: DataFrame, key: str = "model_version",
                 order: Sequence[str] = tuple(g[0] for g in FIXED_GATE_POLICY)) -> DataFrame:
    """All-pass flag and the failed gates in policy order."""
    pos = F.array_position(F.array(*[F.lit(g) for g in order]), F.col("gate"))
    agg = gates.groupBy(key).agg(F.bool_and("passed").alias("gates_passed"),
                                 F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct(pos.alias("p"), F.col("gate"))))
                                              ).alias("_f"))
    return agg.select(key, "gates_passed", F.transform("_f", lambda s: s["gate"]).alias("failed_gates"))


def composite_score(candidates: DataFrame, thresholds: DataFrame, weights: DataFrame, key: str = "model_version") -> DataFrame:
    """Weighted sum: FPR and latency contribute 1 - clip(v / ceiling, 0, 1), the rest clip(v, 0, 1)."""
    t = thresholds.select("gate", "source_metric", "threshold").join(weights, "gate")
    j = candidates.withColumnRenamed("metric", "source_metric").join(F.broadcast(t), "source_metric")
    inverse = F.col("gate").isin("false_positive_rate", "inference_latency_ms_per_row")
    ceiling = F.greatest(F.col("threshold"), F.lit(1e-12))
    norm = F.when(inverse, 1.0 - F.least(F.greatest(F.col("value") / ceiling, F.lit(0.0)), F.lit(1.0))).otherwise(
        F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(1.0)))
    return j.groupBy(key).agg(F.sum(F.col("weight") * norm).alias("composite_score"))


def promotion_decision(candidates: DataFrame, champion_version: Column, allow_cross_mode: bool = False,
                       min_improvement: float = MINIMUM_RELATIVE_IMPROVEMENT, key: str = "model_version") -> DataFrame:
    """``candidates``: key, gates_passed, failed_gates, composite_score, execution_mode (all versions,
    the champion included). Decision: already_champion / promoted / rejected with failed list."""
    champ = candidates.filter(F.col(key) == champion_version).select(
        F.col("composite_score").alias("champion_score"), F.col("execution_mode").alias("champion_mode"),
        F.col(key).alias("champion_version"))
    has = champ.agg(F.count(F.lit(1)).alias("_n"))
    j = candidates.withColumn("_k", F.lit(1)).join(has.withColumn("_k", F.lit(1)), "_k").join(
        champ.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    has_champion = F.col("_n") > 0
    is_champ = has_champion & (F.col(key) == F.col("champion_version"))
    mode_ok = F.lit(True) if allow_cross_mode else (F.col("execution_mode") == F.col("champion_mode"))
    delta = F.col("composite_score") - F.col("champion_score")
    relative = F.when(~has_champion | is_champ, F.lit(True)).when(~mode_ok, F.lit(False)).otherwise(delta >= min_improvement)
    passed = F.col("gates_passed") & relative
    extra = (F.when(has_champion & ~is_champ & ~mode_ok, F.array(F.lit("execution_mode")))
             .when(has_champion & ~is_champ & ~relative, F.array(F.lit("composite_improvement")))
             .otherwise(F.array().cast("array<string>")))
    decision = F.when(is_champ, F.lit("already_champion")).when(passed, F.lit("promoted")).otherwise(F.lit("rejected"))
    return j.select(key, decision.alias("decision"), passed.alias("passed"),
                    F.when(has_champion & ~is_champ & mode_ok, delta).alias("score_delta"),
                    F.when(decision == "rejected", F.concat("failed_gates", extra)).otherwise(
                        F.array().cast("array<string>")).alias("failed_gates"))


def lifecycle_state(events: DataFrame, key: str = "model_version") -> DataFrame:
    """Current state per version: last event by (event_ts, seq); champion = last promoted or rollback target."""
    cur = events.groupBy(key).agg(F.max_by(F.col("state"), F.struct("event_ts", "seq")).alias("state"),
                                  F.max("event_ts").alias("last_event_ts"))
    champ_ev = events.filter(F.col("state").isin("champion")).agg(
        F.max_by(F.col(key), F.struct("event_ts", "seq")).alias("champion_version"))
    return cur.withColumn("_k", F.lit(1)).join(champ_ev.withColumn("_k", F.lit(1)), "_k", "left").select(
        key, "state", "last_event_ts", (F.col(key) == F.col("champion_version")).alias("is_champion"))


def rollback_eligibility(states: DataFrame, metadata: DataFrame, key: str = "model_version",
                         required: Sequence[str] = ("execution_mode", "demo_model", "model_family", "source_run_id")) -> DataFrame:
    """Target must be champion or superseded with required metadata and a source URI; the current
    champion is a no-op (already_current)."""
    j = states.join(metadata, key, "left")
    missing = F.filter(F.array(*[F.when(F.col(r).isNull(), F.lit(r)) for r in required]), lambda x: x.isNotNull())
    reason = (F.when(~F.col("state").isin("champion", "superseded"), F.lit("invalid_target_state"))
              .when(F.size(missing) > 0, F.lit("missing_metadata"))
              .when(F.col("source_model_uri").isNull(), F.lit("missing_source_uri"))
              .when(F.col("is_champion"), F.lit("already_current"))
              .otherwise(F.lit("eligible")))
    return j.select(key, "state", reason.alias("rollback_status"), missing.alias("missing_metadata"))


def duplicate_registration(registrations: DataFrame) -> DataFrame:
    """A candidate with the same (run_id, source) reuses the first registered version."""
    first = registrations.groupBy("run_id", "source").agg(
        F.min_by(F.col("model_version"), F.struct("registered_at", "model_version")).alias("canonical_version"))
    return registrations.join(first, ["run_id", "source"]).select(
        "run_id", "source", "model_version", "canonical_version",
        (F.col("model_version") != F.col("canonical_version")).alias("duplicate"))


def pending_retry(pending: DataFrame, decisions: DataFrame, max_attempts: int, key: str = "model_version") -> DataFrame:
    """Pending candidates re-decided against today's champion: resolved vs still pending; attempts past
    ``max_attempts`` are reported ``exhausted`` (quirk Q10)."""
    j = pending.join(decisions.select(key, "decision"), key, "left")
    status = (F.when(F.col("decision").isin("promoted", "rejected", "already_champion"), F.lit("resolved"))
              .when(F.col("attempts") + 1 >= max_attempts, F.lit("exhausted"))
              .otherwise(F.lit("still_pending")))
    return j.select(key, "attempts", F.coalesce("decision", F.lit("promotion_pending")).alias("outcome"),
                    status.alias("retry_status"))


def version_metrics_cache(cache: DataFrame, current_slice: Column, key: str = "model_version") -> DataFrame:
    """Reuse stored metrics only when evaluated on the same slice fingerprint; else re-score."""
    return cache.select(key, "slice_fingerprint", (F.col("slice_fingerprint") == current_slice).alias("cache_hit"),
                        F.when(F.col("slice_fingerprint") == current_slice, F.lit("reuse")).otherwise(F.lit("rescore")).alias(
                            "action"))


def validate_candidate(manifest: DataFrame, retrained: Column) -> DataFrame:
    """Manifest rules: name, run id, uri, family, source trial, lineage sections; test metrics required
    for a final candidate and forbidden for a retrained one."""
    codes = F.filter(F.array(
        F.when(F.col("model_name").isNull(), F.lit("missing_model_name")),
        F.when(F.col("run_id").isNull(), F.lit("missing_run_id")),
        F.when(F.col("model_uri").isNull() | ~F.col("model_uri").rlike("^(runs|models|file|s3|dbfs):"), F.lit("invalid_model_uri")),
        F.when(F.col("model_family").isNull(), F.lit("missing_model_family")),
        F.when(F.col("source_trial").isNull() & ~retrained, F.lit("missing_source_trial")),
        F.when(F.col("lineage_sections") < 3, F.lit("incomplete_lineage")),
        F.when(~retrained & F.col("test_pr_auc").isNull(), F.lit("missing_test_metrics")),
        F.when(retrained & F.col("test_pr_auc").isNotNull(), F.lit("unexpected_test_metrics"))), lambda x: x.isNotNull())
    return manifest.select("*", (F.size(codes) == 0).alias("valid"), codes.alias("errors"))


def model_listing(states: DataFrame, tags: DataFrame, key: str = "model_version") -> DataFrame:
    """Versions with state (tag, else champion alias), family, mode and the first non-empty reason."""
    j = states.join(tags, key, "left")
    state = F.coalesce(F.col("state_tag"), F.when(F.col("is_champion"), F.lit("champion")), F.col("state"))
    reason = F.coalesce(F.nullif(F.col("failed_gates_tag"), F.lit("")), F.nullif(F.col("rejection_reason"), F.lit("")))
    return j.select(key, state.alias("state"), "model_family", "execution_mode", reason.alias("reason"))


def execution_mode(explicit: Column, evaluated_rows: Column, smoke_max_rows: int = 10_000) -> Column:
    """Explicit mode, else smoke when the evaluation used at most ``smoke_max_rows`` rows."""
    return F.coalesce(explicit, F.when(evaluated_rows <= smoke_max_rows, F.lit("smoke")).otherwise(F.lit("full")))


def params_recovery(params: DataFrame, family_prefix: Column, known: Mapping[str, str] | None = None) -> DataFrame:
    """Champion parameters from prefixed string params, filtered to known keys, typed."""
    from kestrel.functions import parse_param_type

    stripped = params.filter(F.col("key").startswith(family_prefix) if isinstance(family_prefix, str) else
                             F.col("key").startswith(family_prefix))
    out = stripped.select("model_version", F.regexp_replace("key", r"^[^.]+\.", "").alias("param"), "value")
    if known is not None:
        out = out.filter(F.col("param").isin(list(known)))
    return out.select("*", parse_param_type("value").alias("value_type"))

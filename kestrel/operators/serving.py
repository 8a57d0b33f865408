"""Record validation, late-label merge, idempotent appends and the JSONL queue.

All checks are per-row Column expressions over VARIANT / JSON functions (no
Python UDF); merges and idempotent appends are aggregates and anti-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.scalars import strip_ws

# --- feature record validation --------------------------------------------------------------------


def validate_features(df: DataFrame, payload: str, fields: Sequence[str]) -> DataFrame:
    """Adds ``validation_category`` (valid / schema_mismatch / invalid_value / invalid_record /
    malformed_json), ``missing_fields``, ``unexpected_fields``, ``invalid_fields`` (array of
    field:reason) and the ordered typed ``features_typed`` struct (null unless valid).

    ``schema_mismatch`` wins over ``invalid_value``; duplicate keys are malformed JSON. The text is
    parsed once per row (variant, map fallback for NaN / Infinity literals, key list) in a first
    projection; later projections only read those columns. What was read passes through ``inline``: a
    filter on the result stays above it. Below it, every mention of a field would parse the text anew.
    """
    base = df.columns
    p = F.col(payload)
    parsed = df.select("*", F.try_parse_json(p).alias("_v"))
    # an object as a map of variants (null for arrays / scalars); the lenient map parse only runs
    # for text the variant parser refused (NaN / Infinity literals, duplicate keys)
    parsed = parsed.select("*", F.try_variant_get(F.col("_v"), "$", "map<string,variant>").alias("_vm"),
                           F.when(F.col("_v").isNull(), F.from_json(p, "map<string,double>")).alias("_m"))
    v, m, vm = F.col("_v"), F.col("_m"), F.col("_vm")
    typed = []
    for f in fields:
        cell = F.try_element_at(vm, F.lit(f))
        typed += [F.schema_of_variant(cell).alias(f"_t_{f}"),
                  F.coalesce(F.try_variant_get(cell, "$", "double"), F.try_element_at(m, F.lit(f))).alias(f"_x_{f}")]
    step = parsed.select(*base, "_v", "_m", F.coalesce(F.map_keys(vm), F.map_keys(m)).alias("_keys"), *typed)
    keys = F.col("_keys")
    ok_parse = (v.isNotNull() | m.isNotNull()) & ~F.coalesce(F.size(keys) != F.size(F.array_distinct(keys)), F.lit(False))
    expected = F.array(*[F.lit(f) for f in fields])
    reasons = []
    for f in fields:
        vt, val = F.col(f"_t_{f}"), F.col(f"_x_{f}")
        numeric = vt.isin("BIGINT", "DOUBLE", "FLOAT", "INT") | vt.startswith("DECIMAL") | (v.isNull() & m.isNotNull())
        reason = (F.when(vt == "BOOLEAN", F.lit("boolean_not_numeric"))
                  .when(~numeric, F.lit("not_numeric"))
                  .when(val.isNull() | F.isnan(val) | (F.abs(val) == F.lit(float("inf"))), F.lit("not_finite")))
        reasons.append(F.when(F.array_contains(keys, f) & reason.isNotNull(), F.concat(F.lit(f + ":"), reason)))
    step = step.select(*base, ok_parse.alias("_ok"), keys.isNotNull().alias("_obj"),
                       F.array_sort(F.array_except(expected, keys)).alias("_miss"),
                       F.array_sort(F.array_except(keys, expected)).alias("_unexp"),
                       F.filter(F.array(*reasons), lambda x: x.isNotNull()).alias("_inv"),
                       F.struct(*[F.col(f"_x_{f}").alias(f) for f in fields]).alias("_feats"))
    step = step.select(*base, F.inline(F.array(F.struct("_ok", "_obj", "_miss", "_unexp", "_inv", "_feats"))))
    ok, obj = F.col("_ok"), F.col("_obj")
    category = (F.when(~ok, F.lit("malformed_json"))
                .when(~obj, F.lit("invalid_record"))
                .when((F.size("_miss") > 0) | (F.size("_unexp") > 0), F.lit("schema_mismatch"))
                .when(F.size("_inv") > 0, F.lit("invalid_value"))
                .otherwise(F.lit("valid")))
    shown = ok & obj
    return step.select(*base, category.alias("validation_category"),
                       F.when(shown, F.col("_miss")).alias("missing_fields"),
                       F.when(shown, F.col("_unexp")).alias("unexpected_fields"),
                       F.when(shown, F.col("_inv")).alias("invalid_fields"),
                       F.when(category == "valid", F.col("_feats")).alias("features_typed"))


def validate_batch(validated: DataFrame, batch: str, index: str, max_batch_size: int) -> DataFrame:
    """Batch verdict: empty / over limit / any invalid row rejects the whole batch; bad indexes listed."""
    agg = validated.groupBy(batch).agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.count_if(F.col("validation_category") != "valid").alias("invalid_rows"),
        F.array_sort(F.collect_list(F.when(F.col("validation_category") != "valid", F.col(index)))).alias("bad_indexes"))
    verdict = (F.when(F.col("batch_size") == 0, F.lit("empty_batch"))
               .when(F.col("batch_size") > max_batch_size, F.lit("batch_too_large"))
               .when(F.col("invalid_rows") > 0, F.lit("batch_validation_failed"))
               .otherwise(F.lit("accepted")))
    return agg.select("*", verdict.alias("batch_status"))


def validate_observation(obs: DataFrame, id_col: str = "prediction_id", label: str = "ground_truth",
                         version: str = "model_version", category: str = "validation_category") -> DataFrame:
    """approved / rejected with error codes (id, label domain, payload, model version)."""
    codes = F.filter(F.array(
        F.when(F.col(id_col).isNull() | (F.col(id_col) == ""), F.lit("missing_prediction_id")),
        F.when(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)), F.lit("invalid_ground_truth")),
        F.when(F.col(category).isin("malformed_json", "invalid_record"), F.lit("missing_feature_payload")),
        F.when(F.col(category).isin("schema_mismatch", "invalid_value"), F.lit("feature_schema_validation_failed")),
        F.when(F.col(version).isNull() | (F.col(version) == ""), F.lit("missing_source_model_version"))),
        lambda c: c.isNotNull())
    return obs.select("*", F.when(F.size(codes) == 0, F.lit("approved")).otherwise(F.lit("rejected")).alias("validation_status"),
                      codes.alias("validation_errors"))


def rejection_log(validated: DataFrame, id_col: str = "prediction_id") -> DataFrame:
    """Rejected rows with category and field names only - never the payload."""
    return validated.filter(F.col("validation_category") != "valid").select(
        id_col, "validation_category", F.array_join("missing_fields", "|").alias("missing_fields"),
        F.array_join("unexpected_fields", "|").alias("unexpected_fields"),
        F.array_join("invalid_fields", "|").alias("invalid_fields"))


def decode_payload(df: DataFrame, payload: str, fields: Sequence[str]) -> DataFrame:
    """JSON text -> typed feature columns (null when absent or not numeric)."""
    m = F.from_json(F.col(payload), "map<string,double>")
    return df.select("*", *[F.try_element_at(m, F.lit(f)).alias(f"f_{f}") for f in fields])


# --- late labels --------------------------------------------------------------------------------


def first_labels(labels: DataFrame, key: str = "prediction_id", label: str = "label",
                 order: Sequence[str] = ("arrival", "seq")) -> DataFrame:
    """The first delivered label per id (the truth) and its arrival - a partial aggregate."""
    return labels.groupBy(key).agg(
        F.min_by(F.struct(F.col(label).alias("first_label"), *[F.col(o).alias(f"first_{o}") for o in order]),
                 F.struct(*[F.col(o) for o in order])).alias("f")).select(key, "f.*")


def merge_labels(labels: DataFrame, predictions: DataFrame, key: str = "prediction_id", label: str = "label",
                 order: Sequence[str] = ("arrival", "seq")) -> DataFrame:
    """Status per label delivery: recorded (first), idempotent (same later), conflict (different
    later, ignored), unknown (no such prediction, retryable).

    No window over the id: the first label per id is an aggregate joined back, so a
    hot id costs one partial aggregate instead of one oversized task.
    """
    first = first_labels(labels, key, label, order)
    known = predictions.select(key).withColumn("_known", F.lit(True))
    j = labels.join(first, key, "left").join(known, key, "left")
    is_first = F.lit(True)
    for o in order:
        is_first = is_first & (F.col(o) == F.col(f"first_{o}"))
    status = (F.when(F.col("_known").isNull(), F.lit("unknown"))
              .when(is_first, F.lit("recorded"))
              .when(F.col(label) == F.col("first_label"), F.lit("idempotent"))
              .otherwise(F.lit("conflict")))
    return j.select(*labels.columns, status.alias("status"),
                    (F.col("_known").isNull()).alias("retryable"))


def batch_label_verdict(labels: DataFrame, predictions: DataFrame, batch: str = "batch_id",
                        key: str = "prediction_id", label: str = "label") -> DataFrame:
    """All-or-nothing batches: equal repeats collapse; a conflicting repeat or an unknown id voids the batch."""
    known = predictions.select(key).withColumn("_known", F.lit(True))
    per_id = labels.groupBy(batch, key).agg(F.count_distinct(label).alias("_labels"))
    j = per_id.join(known, key, "left")
    return j.groupBy(batch).agg(
        F.count(F.lit(1)).alias("distinct_ids"),
        F.count_if(F.col("_labels") > 1).alias("conflicting_ids"),
        F.count_if(F.col("_known").isNull()).alias("unknown_ids")).select(
        "*", F.when((F.col("conflicting_ids") == 0) & (F.col("unknown_ids") == 0), F.lit("applied"))
        .when(F.col("conflicting_ids") > 0, F.lit("conflict")).otherwise(F.lit("unknown")).alias("batch_status"))


def labelled_view(predictions: DataFrame, labels: DataFrame, key: str = "prediction_id", label: str = "label",
                  order: Sequence[str] = ("arrival", "seq")) -> DataFrame:
    """Predictions with the first label as ground truth and its arrival as receipt time."""
    first = first_labels(labels, key, label, order).select(
        key, F.col("first_label").alias("ground_truth"), F.col(f"first_{order[0]}").alias("ground_truth_received_at"))
    base = predictions.drop("ground_truth", "ground_truth_received_at")
    return base.join(first, key, "left")


# --- idempotent appends and the queue -------------------------------------------------------------


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` to append: first row per key inside the batch, and only keys not in ``target``."""
    cols = incoming.columns
    firsts = incoming.groupBy(key).agg(F.min_by(F.struct(*[c for c in cols if c != key]),
                                                F.struct(*[F.col(o) for o in order])).alias("r"))
    firsts = firsts.select(key, "r.*").select(*cols)
    return firsts.join(target.select(key), key, "left_anti")


def scan_jsonl_queue(lines: DataFrame, text: str = "value") -> DataFrame:
    """Classify queue lines: blank (white space only, skipped), valid (an object whose prediction_id is
    neither absent, null, "", 0, false, [] nor {}), malformed."""
    parsed = lines.select("*", F.try_parse_json(F.col(text)).alias("_v"))
    pid = F.try_variant_get("_v", "$.prediction_id", "string")
    kind_of = F.schema_of_variant(F.try_variant_get("_v", "$.prediction_id", "variant"))
    number = kind_of.isin("BIGINT", "DOUBLE", "FLOAT") | kind_of.startswith("DECIMAL")
    empty = (pid.isNull() | ((kind_of == "STRING") & (pid == "")) | ((kind_of == "BOOLEAN") & (pid == "false"))
             | (number & (F.try_variant_get("_v", "$.prediction_id", "double") == 0)) | pid.isin("[]", "{}") & (kind_of != "STRING"))
    is_obj = F.schema_of_variant("_v").startswith("OBJECT")
    kind = (F.when(strip_ws(text) == "", F.lit("blank"))
            .when(F.coalesce(is_obj & ~empty, F.lit(False)), F.lit("valid"))
            .otherwise(F.lit("malformed")))
    return parsed.select(*lines.columns, kind.alias("line_status"), F.when(kind == "valid", pid).alias("prediction_id"))


def drain_queue(queue: DataFrame, log: DataFrame, order: str = "line_no") -> DataFrame:
    """One-row report: attempted (valid lines), persisted (new ids), remaining, malformed, blank."""
    valid = queue.filter(F.col("line_status") == "valid")
    new = insert_if_absent(log.select("prediction_id"), valid.select("prediction_id", order), "prediction_id", [order])
    c = queue.agg(F.count_if(F.col("line_status") == "valid").alias("attempted"),
                  F.count_if(F.col("line_status") == "malformed").alias("malformed"),
                  F.count_if(F.col("line_status") == "blank").alias("blank"))
    p = new.agg(F.count(F.lit(1)).alias("persisted"))
    return c.withColumn("_k", F.lit(1)).join(p.withColumn("_k", F.lit(1)), "_k").select("attempted", "persisted", F.lit(0).cast("bigint").alias("remaining"),
                                         "malformed", "blank")

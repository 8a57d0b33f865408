"""Validation of raw captures and processed partitions as rule tables.

A rule table has one row per rule: ``(rule, scope, severity, passed, detail)``.
Every rule is an aggregate over the data; no row-level data leaves the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import is_finite


def _dup_rows(df: DataFrame, group: str, keys: Sequence[str], name: str) -> DataFrame:
    """Rows minus distinct ``keys`` per ``group``: a two-level count, no Expand, no collected sets."""
    per_key = df.groupBy(group, *keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(group).agg(F.sum(F.col("_n") - 1).cast("bigint").alias(name))


def partition_stats(processed: DataFrame, features: Sequence[str], target: str = "target",
                    part: str = "source_partition") -> DataFrame:
    """Per partition: rows, class counts, source files, missing / infinite cells, duplicates."""
    missing = sum((F.col(c).isNull() | F.isnan(F.col(c))).cast("bigint") for c in features)
    infinite = sum((F.abs(F.col(c)) == F.lit(float("inf"))).cast("bigint") for c in features)
    base = processed.groupBy(part).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(target) == 0).alias("benign_rows"),
        F.count_if(F.col(target) == 1).alias("attack_rows"),
        F.array_join(F.array_sort(F.collect_set("source_file")), ",").alias("source_files"),
        F.sum(missing).cast("bigint").alias("missing_feature_values"),
        F.sum(F.coalesce(infinite, F.lit(0))).cast("bigint").alias("infinite_feature_values"))
    dig = _dup_rows(processed, part, ["row_digest"], "duplicate_raw_observation_rows")
    ft = _dup_rows(processed, part, [*features, target], "duplicate_feature_target_rows")
    return base.join(dig, part, "left").join(ft, part, "left")


def class_counts(df: DataFrame, target: str = "target", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, target).agg(F.count(F.lit(1)).alias("row_count"))


def finite_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """validate_numeric: per column non-null, non-finite and null counts, one wide aggregate."""
    aggs = []
    for c in features:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__null"),
                 F.count_if(F.col(c).isNotNull() & ~is_finite(c)).alias(f"{c}__non_finite")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__null`, `{c}__non_finite`" for c in features)
    return wide.selectExpr(f"stack({len(features)}, {stack}) AS (column_name, null_count, non_finite_count)")


SPLIT_PARTITIONS = ("train", "validation", "test")


def partition_leakage(df: DataFrame, key: str = "row_digest", part: str = "source_partition",
                      partitions: Sequence[str] = SPLIT_PARTITIONS) -> DataFrame:
    """Digests shared by two of train / validation / test: one shuffle on the digest.

    The per-digest set holds at most ``len(partitions)`` names (bounded), so a hot
    digest stays cheap; pairs are emitted from that bounded set only.
    """
    per = (df.filter(F.col(part).isin(list(partitions))).groupBy(key)
           .agg(F.array_sort(F.collect_set(part)).alias("parts")).filter(F.size("parts") > 1))
    order = F.array(*[F.lit(p) for p in partitions])
    pairs = per.select(key, F.explode(F.filter(
        F.transform(F.arrays_zip(order.alias("a")), lambda z: z["a"]), lambda a: F.array_contains("parts", a))).alias("left"),
        "parts")
    pairs = pairs.select(key, "left", F.explode("parts").alias("right")).filter(
        F.array_position(order, F.col("left")) < F.array_position(order, F.col("right")))
    return pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared_digests"))


def digest_intersection(df: DataFrame, left: str, right: str, key: str = "row_digest",
                        part: str = "source_partition") -> DataFrame:
    a = df.filter(F.col(part) == left).select(key)
    b = df.filter(F.col(part) == right).select(key)
    return a.intersect(b)


def reference_subset(processed: DataFrame, part: str = "source_partition") -> DataFrame:
    """Reference source files that are not train source files (must be empty)."""
    ref = processed.filter(F.col(part) == "reference").select("source_file").distinct()
    train = processed.filter(F.col(part) == "train").select("source_file").distinct()
    return ref.join(train, "source_file", "left_anti")


def manifest_diff(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Full outer comparison of an expected and an observed name list: ok / missing / unexpected."""
    e = expected.select(F.col(key), F.lit(True).alias("_e")).distinct()
    o = observed.select(F.col(key), F.lit(True).alias("_o")).distinct()
    j = e.join(o, key, "full")
    status = (F.when(F.col("_e") & F.col("_o"), F.lit("ok")).when(F.col("_e"), F.lit("missing"))
              .otherwise(F.lit("unexpected")))
    return j.select(key, status.alias("status"))


def rule(name: str, scope, passed, detail, severity: str = "failure"):
    return F.struct(F.lit(name).alias("rule"), scope.alias("scope") if not isinstance(scope, str) else F.lit(scope).alias("scope"),
                    F.lit(severity).alias("severity"), passed.alias("passed"), detail.cast("string").alias("detail"))


def validate_processed(processed: DataFrame, features: Sequence[str], target: str = "target",
                       part: str = "source_partition", minimum_rows: int = 1,
                       provenance: Sequence[str] = ("source_file", "source_day", "source_partition",
                                                    "source_row_number", "row_digest")) -> DataFrame:
    """Rule table for processed partitions (one row per rule and partition, plus global rules)."""
    forbidden = {target, "original_label", *provenance}
    leaked = sorted(forbidden & set(features))
    missing_cols = sorted(set([*features, target]) - set(processed.columns))
    numeric = {f.name for f in processed.schema.fields
               if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")}
    non_numeric = sorted(set(features) - numeric)
    stats = partition_stats(processed, features, target, part)
    bad_target = processed.groupBy(part).agg(F.count_if(~F.col(target).isin(0, 1)).alias("bad_target"))
    s = stats.join(bad_target, part, "left")
    per_part = s.select(F.explode(F.array(
        rule("target_domain", F.col(part), F.col("bad_target") == 0, F.col("bad_target")),
        rule("minimum_rows", F.col(part), F.col("row_count") >= minimum_rows, F.col("row_count")),
        rule("missing_feature_values", F.col(part), F.col("missing_feature_values") == 0, F.col("missing_feature_values")),
        rule("infinite_feature_values", F.col(part), F.col("infinite_feature_values") == 0, F.col("infinite_feature_values")),
        rule("duplicate_raw_observations", F.col(part), F.col("duplicate_raw_observation_rows") == 0,
             F.col("duplicate_raw_observation_rows")),
        rule("duplicate_feature_target_rows", F.col(part), F.lit(True), F.col("duplicate_feature_target_rows"),
             "info"))).alias("r")).select("r.*")
    leak = partition_leakage(processed, "row_digest", part)
    leak_rule = leak.agg(F.coalesce(F.sum("shared_digests"), F.lit(0)).alias("n")).select(
        rule("cross_partition_leakage", "train|validation|test", F.col("n") == 0, F.col("n")).alias("r")).select("r.*")
    outside = reference_subset(processed, part).agg(F.count(F.lit(1)).alias("n")).select(
        rule("reference_subset_of_train", "reference", F.col("n") == 0, F.col("n")).alias("r")).select("r.*")
    spark = processed.sparkSession
    static = spark.createDataFrame(
        [("leaked_feature_columns", "schema", "failure", not leaked, "|".join(leaked)),
         ("missing_columns", "schema", "failure", not missing_cols, "|".join(missing_cols)),
         ("non_numeric_features", "schema", "failure", not non_numeric, "|".join(non_numeric))],
        "rule string, scope string, severity string, passed boolean, detail string")
    return static.unionByName(per_part).unionByName(leak_rule).unionByName(outside)


def validate_raw(raw_cells: DataFrame, headers: DataFrame, reference_header: Sequence[str], label_position: int,
                 known_labels: Sequence[str], expected_files: Sequence[str], duplicate_pair: tuple[int, int] | None,
                 minimum_rows: int = 1) -> DataFrame:
    """Rule table for raw captures.

    ``raw_cells``: (source_file, c_0..c_{n-1}, row_length_mismatch); ``headers``:
    (source_file, col_index, column_name). Rules: expected files present, no
    unexpected files, header matches (trimmed), labels known, row lengths, duplicate
    column values equal, minimum rows per file.
    """
    from kestrel.operators.profile import header_check

    spark = raw_cells.sparkSession
    lab = F.trim(F.col(f"c_{label_position}"))
    dup_eq = (F.col(f"c_{duplicate_pair[0]}") == F.col(f"c_{duplicate_pair[1]}")) if duplicate_pair else F.lit(True)
    per_file = raw_cells.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~lab.isin(list(known_labels))).alias("unknown_labels"),
        F.count_if(F.col("row_length_mismatch")).alias("length_mismatch"),
        F.count_if(~dup_eq).alias("dup_mismatch"))
    hc = header_check(headers, reference_header)
    j = per_file.join(hc, "source_file", "left")
    rules = j.select(F.explode(F.array(
        rule("minimum_rows", F.col("source_file"), F.col("rows") >= minimum_rows, F.col("rows")),
        rule("known_labels", F.col("source_file"), F.col("unknown_labels") == 0, F.col("unknown_labels")),
        rule("row_lengths", F.col("source_file"), F.col("length_mismatch") == 0, F.col("length_mismatch"), "warning"),
        rule("duplicate_column_equal", F.col("source_file"), F.col("dup_mismatch") == 0, F.col("dup_mismatch")),
        rule("header_trimmed_match", F.col("source_file"), F.coalesce(F.col("trimmed_header_match"), F.lit(False)),
             F.col("extra_vs_reference")),
        rule("header_exact_match", F.col("source_file"), F.coalesce(F.col("exact_header_match"), F.lit(False)),
             F.col("whitespace_padded_names"), "warning"))).alias("r")).select("r.*")
    exp = spark.createDataFrame([(f,) for f in expected_files], "source_file string")
    diff = manifest_diff(exp, raw_cells.select("source_file"), "source_file").filter(F.col("status") != "ok")
    file_rules = diff.select(rule("expected_files", F.col("source_file"), F.lit(False), F.col("status")).alias("r")).select("r.*")
    return rules.unionByName(file_rules)


def no_test_source(df: DataFrame, part: str = "source_partition", path: str | None = None) -> DataFrame:
    """Refuse a held-out test read: a path guard plus a data check (stronger than a path match)."""
    if path is not None and "test" in path.replace("\\", "/").split("/")[-1]:
        raise ValueError(f"refusing to read the held-out test partition: {path}")
    if part in df.columns and not df.filter(F.col(part) == "test").isEmpty():
        raise ValueError("held-out test rows found in a monitoring / simulation / retraining input")
    return df


def schema_fingerprint_check(observations: DataFrame, current: str, col: str = "schema_fingerprint") -> DataFrame:
    """Observations whose contract fingerprint differs from the current contract (to be excluded)."""
    return observations.select("*", (F.col(col) == F.lit(current)).alias("schema_matches"))

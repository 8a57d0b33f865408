"""Raw flow lines -> deduplicated, coerced, cleaned and partitioned rows.

Plan shape at scale: one hash shuffle on ``row_digest`` (first-copy dedup as an
aggregate with map-side combine, so a digest repeated in a third of all rows is
collapsed before it crosses the network), then narrow projections only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.contracts import DEFAULT_ASSIGNMENT
from kestrel.functions import (
    all_finite, assign_partition, coerce_numeric, day_from_file, day_order, is_finite, is_known_label,
    label_to_target, reference_member, row_digest,
)


def with_digest(raw: DataFrame, line_col: str = "line") -> DataFrame:
    """Adds ``row_digest`` (SHA-256 of the raw line), ``source_day`` and ``day_ord``."""
    return (raw.withColumn("row_digest", row_digest(line_col))
            .withColumn("source_day", day_from_file("source_file"))
            .withColumn("day_ord", day_order("source_day")))


def dedup_first(df: DataFrame, key: str = "row_digest",
                order: Sequence[str] = ("day_ord", "source_file", "source_row_number")) -> DataFrame:
    """Keep the first occurrence of each key in (file order, row) order, globally.

    Expressed as ``min_by(row, order)`` per key: one shuffle with partial aggregation,
    deterministic (unlike ``dropDuplicates``) and skew-safe.
    """
    payload = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(
        F.min_by(F.struct(*payload), F.struct(*[F.col(c) for c in order])).alias("_first"))
    return agg.select(key, *[F.col("_first")[c].alias(c) for c in payload]).select(*df.columns)


def split_columns(line, n: int, sep: str = ","):
    """Split a line into ``n`` positional string cells; short rows pad with '' and long rows truncate."""
    arr = F.split(line, sep, -1)
    return [F.coalesce(F.get(arr, i), F.lit("")) for i in range(n)], F.size(arr) != F.lit(n)


def parse_flows(deduped: DataFrame, feature_names: Sequence[str], label_position: int,
                feature_positions: Sequence[int] | None = None) -> DataFrame:
    """Cells -> typed features (double), ``original_label`` and flag columns.

    The line is split once and the coerced features are built as one array, so a filter on
    ``finite_row`` pushed below this projection repeats one array expression, not every cell.
    """
    n = label_position + 1
    if feature_positions is None:
        feature_positions = list(range(len(feature_names)))
    cols = [F.col(c) for c in deduped.columns if c != "line"]
    names = [c for c in deduped.columns if c != "line"]
    step = deduped.select(*cols, F.split(F.col("line"), ",", -1).alias("_cells"))
    cell = lambda i: F.coalesce(F.get(F.col("_cells"), i), F.lit(""))
    feats = F.array(*[coerce_numeric(cell(p)) for p in feature_positions])
    step = step.select(*names, F.trim(cell(label_position)).alias("original_label"), feats.alias("_f"),
                       (F.size("_cells") != F.lit(n)).alias("row_length_mismatch"))
    finite = F.forall(F.col("_f"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return step.select(*names, "original_label", *[F.col("_f")[i].alias(nm) for i, nm in enumerate(feature_names)],
                       "row_length_mismatch", is_known_label("original_label").alias("known_label"),
                       finite.alias("finite_row"))


def clean_rows(parsed: DataFrame) -> DataFrame:
    """Keep known-label rows whose features are all finite; add ``target``."""
    return (parsed.filter(F.col("known_label") & F.col("finite_row"))
            .withColumn("target", label_to_target("original_label")))


def with_partition(df: DataFrame, assignment=DEFAULT_ASSIGNMENT) -> DataFrame:
    return df.withColumn("source_partition", assign_partition("source_day", assignment))


PROCESSED_LEAD = ("source_file", "source_day", "source_partition", "source_row_number", "row_digest",
                  "original_label", "target")


def prepare_flows(raw: DataFrame, feature_names: Sequence[str], label_position: int,
                  assignment=DEFAULT_ASSIGNMENT, reference_fraction: float = 0.1,
                  reference_modulus: int = 1_000_000) -> DataFrame:
    """Full prepare: digest -> first-copy dedup -> parse -> clean -> weekday split.

    Returns the processed rows of train / validation / test plus the hash-sampled
    ``reference`` rows (a subset of train) under ``source_partition = 'reference'``.
    """
    deduped = dedup_first(with_digest(raw))
    cleaned = with_partition(clean_rows(parse_flows(deduped, feature_names, label_position)), assignment)
    # a train row in the hash sample is emitted a second time as 'reference': one pass, no union
    in_ref = (F.col("source_partition") == "train") & reference_member(F.col("row_digest"), reference_fraction,
                                                                       reference_modulus)
    parts = F.filter(F.array(F.col("source_partition"), F.when(in_ref, F.lit("reference"))), lambda x: x.isNotNull())
    out = cleaned.withColumn("source_partition", F.explode(parts))
    return out.select(*PROCESSED_LEAD, *feature_names)


def removal_counts(raw: DataFrame, feature_names: Sequence[str], label_position: int) -> DataFrame:
    """Per file: rows seen, duplicates, unknown labels, invalid numeric, written.

    Reasons overlap (quirk Q4); ``first_reason`` counts are disjoint (duplicate first,
    then unknown label, then invalid numeric).
    """
    dg = with_digest(raw)
    seen = dg.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows_seen"))
    first = dedup_first(dg)
    parsed_all = parse_flows(dg, feature_names, label_position)
    parsed_first = parse_flows(first, feature_names, label_position)
    by_all = parsed_all.groupBy("source_file").agg(
        F.count_if(~F.col("known_label")).alias("unknown_label_rows"),
        F.count_if(~F.col("finite_row")).alias("invalid_numeric_rows"),
        F.count_if(F.col("row_length_mismatch")).alias("row_length_mismatches"))
    by_first = parsed_first.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("first_copies"),
        F.count_if(~F.col("known_label")).alias("first_unknown_label"),
        F.count_if(F.col("known_label") & ~F.col("finite_row")).alias("first_invalid_numeric"),
        F.count_if(F.col("known_label") & F.col("finite_row")).alias("rows_written"))
    # a file whose rows are all copies of earlier files has no first copies: left join, count 0
    j = seen.join(by_all, "source_file").join(by_first, "source_file", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return j.select("source_file", "rows_seen", (F.col("rows_seen") - z("first_copies")).alias("duplicate_rows"),
                    "unknown_label_rows", "invalid_numeric_rows", "row_length_mismatches",
                    z("first_unknown_label").alias("first_reason_unknown_label"),
                    z("first_invalid_numeric").alias("first_reason_invalid_numeric"), z("rows_written").alias("rows_written"))


def finite_flag(c: str):
    return is_finite(c)

"""Raw-capture profiling: token classes, constants, dominant values, duplicates, labels.

Token counts, extremes and heavy cells come from one Arrow pass over the lines (``summaries``);
the tall form (a row a cell) is left to per-cell queries and to nearly unique columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions import canonical_name, row_digest
from kestrel.operators import summaries as S
from kestrel.operators.clean import split_columns

NEAR_CONSTANT_THRESHOLD = 0.995
OVERALL = S.OVERALL


def cells_wide(raw: DataFrame, n: int) -> DataFrame:
    """(source_file, c_0 ... c_{n-1}, row_length_mismatch) from raw lines."""
    cells, bad = split_columns(F.col("line"), n)
    return raw.select("source_file", *[c.alias(f"c_{i}") for i, c in enumerate(cells)], bad.alias("row_length_mismatch"))


def cells_tall(raw: DataFrame, header: Sequence[str]) -> DataFrame:
    """(source_file, col_index, column_name, cell) - only for value-count work."""
    wide = cells_wide(raw, len(header))
    arr = F.array(*[F.struct(F.lit(i).alias("col_index"), F.lit(h).alias("column_name"), F.col(f"c_{i}").alias("cell"))
                    for i, h in enumerate(header)])
    return wide.select("source_file", F.inline(arr))


def named_columns(raw: DataFrame, header: Sequence[str]) -> DataFrame:
    rows = [(i, h) for i, h in enumerate(header)]
    return F.broadcast(raw.sparkSession.createDataFrame(rows, "col_index int, column_name string"))  # the header


def column_profile(raw: DataFrame, header: Sequence[str], summaries: DataFrame | None = None) -> DataFrame:
    """Per file and overall (``source_file = '*'``), per column: token-class counts, missing, +inf, -inf,
    constant flag and value, from one pass of column summaries."""
    p = S.profile_of(summaries if summaries is not None else S.column_summaries(raw, len(header)))
    return p.join(named_columns(raw, header), "col_index").select(
        "source_file", "col_index", "column_name", "rows", "missing", (F.col("pos_inf") + F.col("neg_inf")).alias("infinite"),
        "pos_inf", "neg_inf", "integer", "float", "string", "constant", "constant_value")


def infer_dtype(profile: DataFrame, label_column: str = "label") -> DataFrame:
    """Column type from token counts: string > float/inf > integer > missing; the label is categorical."""
    is_label = F.lower(F.trim(F.col("column_name"))) == label_column
    dtype = (F.when(is_label, F.lit("categorical/string target"))
             .when(F.col("string") > 0, F.lit("string"))
             .when((F.col("float") > 0) | (F.col("infinite") > 0), F.lit("float64-compatible numeric"))
             .when(F.col("integer") > 0, F.lit("int64-compatible numeric"))
             .when(F.col("missing") > 0, F.lit("all missing/empty"))
             .otherwise(F.lit("unknown/no observed values")))
    return profile.select("source_file", "col_index", "column_name", dtype.alias("dtype_inferred"))


def dominant_value(raw: DataFrame, header: Sequence[str], threshold: float = NEAR_CONSTANT_THRESHOLD,
                   summaries: DataFrame | None = None) -> DataFrame:
    """True mode per column (ties by smallest value), its count and ratio; near-constant at ratio >= threshold.
    Candidates come from the column summaries' heavy hitters, their counts from an exact recount."""
    summaries = summaries if summaries is not None else S.column_summaries(raw, len(header))
    top = S.dominant_cells(raw, summaries, len(header))
    rows = summaries.groupBy("source_file", "col_index").agg(F.sum("rows").alias("rows"))
    rows = rows.unionByName(rows.groupBy("col_index").agg(F.sum("rows").alias("rows")).withColumn("source_file", F.lit(OVERALL)))
    ratio = F.col("n") / F.col("rows")
    return top.join(rows, ["source_file", "col_index"]).join(named_columns(raw, header), "col_index").select(
        "source_file", "col_index", "column_name", F.col("cell").alias("dominant_value"),
        F.col("n").cast("bigint").alias("dominant_count"), ratio.alias("dominant_ratio"), (ratio >= threshold).alias("near_constant"))


def duplicate_counts(raw: DataFrame) -> DataFrame:
    """Repeated raw lines within each file and globally; unique digests."""
    d = raw.select("source_file", row_digest("line").alias("d"))
    per = d.groupBy("source_file", "d").agg(F.count(F.lit(1)).alias("n"))
    files = per.groupBy("source_file").agg(F.sum("n").cast("bigint").alias("rows"),
                                           F.count(F.lit(1)).alias("unique_row_digests"))
    glob = per.groupBy("d").agg(F.sum("n").alias("n")).agg(
        F.sum("n").cast("bigint").alias("rows"), F.count(F.lit(1)).alias("unique_row_digests")).select(
        F.lit(OVERALL).alias("source_file"), "rows", "unique_row_digests")
    both = files.unionByName(glob)
    return both.select("*", (F.col("rows") - F.col("unique_row_digests")).alias("duplicate_rows"))


def label_inventory(labelled: DataFrame, label: str = "label", file: str = "source_file") -> DataFrame:
    """Rows per (file, label) and overall, binary class, share within file."""
    per = labelled.groupBy(file, F.trim(F.col(label)).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    overall = per.groupBy("label").agg(F.sum("rows").alias("rows")).select(F.lit(OVERALL).alias(file), "label", "rows")
    both = per.unionByName(overall)
    w = Window.partitionBy(file)
    return both.select(file, "label", F.col("rows").cast("bigint").alias("rows"),
                       F.when(F.col("label") == "BENIGN", F.lit("BENIGN")).otherwise(F.lit("ATTACK")).alias("binary_class"),
                       (F.col("rows") / F.sum("rows").over(w)).alias("share"))


def attack_types_by_file(inventory: DataFrame, file: str = "source_file") -> DataFrame:
    return inventory.groupBy(file).agg(
        F.array_sort(F.collect_set(F.when(F.col("label") != "BENIGN", F.col("label")))).alias("attack_types"),
        F.array_sort(F.collect_set("label")).alias("labels_present"))


def review_columns(profile: DataFrame, dominant: DataFrame, header_dups: DataFrame) -> DataFrame:
    """Leakage / constant / near-constant / duplicate-name / target-like reasons per overall column."""
    p = profile.filter(F.col("source_file") == OVERALL).select("col_index", "column_name", "constant")
    d = dominant.filter(F.col("source_file") == OVERALL).select("col_index", "near_constant", "dominant_ratio")
    j = p.join(d, "col_index").join(header_dups, F.trim(p["column_name"]) == header_dups["trimmed_name"], "left")
    name = F.trim(F.col("column_name"))
    lo = F.lower(name)
    reasons = F.array(
        F.when(name == "Destination Port", F.lit("network endpoint/service attribute can encode scenario identity")),
        F.when(name.isin("Protocol", "Flow ID", "Source IP", "Src IP", "Destination IP", "Dst IP", "Timestamp"),
               F.lit("identifier or temporal metadata can leak across file/time splits")),
        F.when(F.col("trimmed_name").isNotNull(), F.lit("duplicate column name appears at multiple positions")),
        F.when(F.col("constant"), F.lit("constant across all discovered raw files")),
        F.when(~F.col("constant") & F.col("near_constant"),
               F.concat(F.lit("near-constant at "), F.format_number(F.col("dominant_ratio") * 100, 4), F.lit("%"))),
        F.when(lo.contains("label") | lo.contains("class") | lo.contains("attack"),
               F.lit("target-like name; keep out of feature matrix")))
    clean = F.array_sort(F.array_distinct(F.filter(reasons, lambda r: r.isNotNull())))
    return j.select("col_index", "column_name", name.alias("trimmed_name"), clean.alias("reasons")).filter(
        F.size("reasons") > 0)


def duplicate_names(headers: DataFrame) -> DataFrame:
    """Trimmed header names that occur at more than one position (from the first file's header)."""
    return headers.groupBy(F.trim("column_name").alias("trimmed_name")).agg(
        F.count(F.lit(1)).alias("positions")).filter(F.col("positions") > 1)


def header_check(headers: DataFrame, reference_header: Sequence[str]) -> DataFrame:
    """Per file vs the reference header (the first file in file order): exact and trimmed equality,
    names missing from the file and extra names, whitespace-padded names.

    ``headers``: (source_file, col_index, column_name). Headers are schema metadata
    (one short list per file), so the per-file array is bounded by the column count.
    """
    per = headers.groupBy("source_file").agg(
        F.sort_array(F.collect_list(F.struct("col_index", "column_name"))).alias("cols"))
    mine = F.transform("cols", lambda s: s["column_name"])
    theirs = F.array(*[F.lit(h) for h in reference_header])
    trim_all = lambda a: F.transform(a, lambda x: F.trim(x))
    padded = F.size(F.filter(mine, lambda x: F.length(x) != F.length(F.trim(x))))
    return per.select(
        "source_file", F.size(mine).alias("column_count"), (mine == theirs).alias("exact_header_match"),
        (trim_all(mine) == trim_all(theirs)).alias("trimmed_header_match"),
        F.array_join(F.array_except(theirs, mine), "|").alias("missing_from_reference"),
        F.array_join(F.array_except(mine, theirs), "|").alias("extra_vs_reference"),
        padded.alias("whitespace_padded_names"))


def column_plan(headers: DataFrame, profile: DataFrame, label_column: str = "label") -> DataFrame:
    """Per column of the reference header: target / drop (constant) / drop (duplicate position) / keep.

    Canonical names are made unique with ``_pos_{i}`` when a name repeats.
    """
    p = profile.filter(F.col("source_file") == OVERALL).select("col_index", "constant")
    canon = canonical_name("column_name")
    w = Window.partitionBy(canon).orderBy("col_index")
    h = headers.join(p, "col_index", "left").select("col_index", "column_name", canon.alias("canonical"),
                                                    "constant", F.row_number().over(w).alias("occurrence"))
    action = (F.when(F.lower(F.trim("column_name")) == label_column, F.lit("target"))
              .when(F.col("occurrence") > 1, F.lit("drop_duplicate"))
              .when(F.col("constant"), F.lit("drop_constant"))
              .otherwise(F.lit("keep")))
    name = F.when(F.col("occurrence") > 1, F.concat("canonical", F.lit("_pos_"), F.col("col_index").cast("string"))
                  ).otherwise(F.col("canonical"))
    return h.select("col_index", "column_name", name.alias("canonical_name"), action.alias("action"))


def size_estimate(rows: DataFrame, columns: int) -> DataFrame:
    """Dense float64 matrix bytes excluding the label: rows * (columns - 1) * 8."""
    return rows.select("*", (F.col("rows") * (columns - 1) * 8).alias("dense_float64_bytes"),
                       F.round(F.col("rows") * (columns - 1) * 8 / (1024 * 1024), 3).alias("dense_float64_mb"))

"""Registered queries: raw capture profiling, cleaning and the weekday split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.contracts import DEFAULT_ASSIGNMENT
from kestrel.functions import (
    assign_partition, canonical_name, coerce_numeric, day_from_file, day_order, is_finite, is_known_label,
    label_to_target, reference_member, row_digest, scenario_from_file, token_type,
)
from kestrel.operators import clean as C
from kestrel.operators import profile as P
from kestrel.operators import validate as V
from kestrel.plans import adapters as A
from kestrel.plans import oracle as O
from kestrel.plans.registry import register

FLOWS = O.with_ctes(O.RAW_FLOWS)
ORDERS = O.with_ctes(O.RAW_ORDERS)


def _flows(spark, sf):
    return A.raw_flows(spark, sf)


@register("removal_counts", FLOWS + """,
seen AS (SELECT source_file, count(*) AS rows_seen, count(*) FILTER (WHERE NOT known_label) AS unknown_label_rows,
                count(*) FILTER (WHERE NOT finite_row) AS invalid_numeric_rows,
                count(*) FILTER (WHERE row_length_mismatch) AS row_length_mismatches,
                count(*) FILTER (WHERE rn > 1) AS duplicate_rows,
                count(*) FILTER (WHERE rn = 1 AND NOT known_label) AS first_reason_unknown_label,
                count(*) FILTER (WHERE rn = 1 AND known_label AND NOT finite_row) AS first_reason_invalid_numeric,
                count(*) FILTER (WHERE rn = 1 AND known_label AND finite_row) AS rows_written
         FROM flagged GROUP BY source_file)
SELECT * FROM seen""")
def q_removal_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.removal_counts(_flows(spark, sf), A.FLOW_FEATURES, A.FLOW_LABEL_POSITION)


@register("dedup_first", FLOWS + """
SELECT source_file, source_row_number, row_digest FROM ranked WHERE rn = 1""")
def q_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    d = C.dedup_first(C.with_digest(_flows(spark, sf)))
    return d.select("source_file", "source_row_number", "row_digest")


@register("row_digest", FLOWS + """
SELECT source_file, source_row_number, row_digest, count(*) AS copies FROM digested GROUP BY ALL""")
def q_row_digest(spark: SparkSession, sf: str) -> DataFrame:
    d = _flows(spark, sf).select("source_file", "source_row_number", row_digest("line").alias("row_digest"))
    return d.groupBy("source_file", "source_row_number", "row_digest").agg(F.count(F.lit(1)).alias("copies"))


@register("clean_rows", FLOWS + """
SELECT source_file, source_day, source_partition, source_row_number, row_digest, original_label, CAST(target AS INTEGER) AS target,
       line_number, quantity, discount, tax FROM cleaned""")
def q_clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = A.flows_processed(spark, sf).filter(F.col("source_partition") != "reference")
    return p.withColumn("target", F.col("target").cast("int"))


@register("split_columns", ORDERS + """
SELECT source_file, source_row_number, split_part(line, ',', 2) AS c_1, split_part(line, ',', 3) AS c_2,
       split_part(line, ',', 10) AS c_9, split_part(line, ',', 11) AS c_10, len(string_split(line, ',')) <> 11 AS row_length_mismatch
FROM raw_orders""")
def q_split_columns(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.raw_orders(spark, sf)
    cells, bad = C.split_columns(F.col("line"), 11)
    return raw.select("source_file", "source_row_number", cells[1].alias("c_1"), cells[2].alias("c_2"),
                      cells[9].alias("c_9"), cells[10].alias("c_10"), bad.alias("row_length_mismatch"))


@register("ordered_files", FLOWS + """,
files AS (SELECT DISTINCT source_file, source_day, day_ord FROM digested)
SELECT source_file, source_day, day_ord, row_number() OVER (ORDER BY day_ord, source_file) AS file_rank FROM files""")
def q_ordered_files(spark: SparkSession, sf: str) -> DataFrame:
    files = C.with_digest(_flows(spark, sf)).select("source_file", "source_day", "day_ord").distinct()
    # the file list is metadata (one row per capture file); ranking it globally is bounded
    from pyspark.sql import Window
    return files.withColumn("file_rank", F.row_number().over(Window.orderBy("day_ord", "source_file")))


@register("day_scenario", ORDERS + """
SELECT DISTINCT source_file, split_part(source_file, '-', 1) AS day,
       substr(replace(source_file, '.pcap_ISCX.csv', ''), strpos(replace(source_file, '.pcap_ISCX.csv', ''), '-') + 1) AS scenario
FROM raw_orders""")
def q_day_scenario(spark: SparkSession, sf: str) -> DataFrame:
    f = A.raw_orders(spark, sf).select("source_file").distinct()
    return f.select("source_file", day_from_file("source_file").alias("day"), scenario_from_file("source_file").alias("scenario"))


@register("assign_partition", ORDERS + """
SELECT source_file, count(*) AS rows,
       CASE WHEN split_part(source_file, '-', 1) IN ('Monday','Tuesday','Wednesday') THEN 'train'
            WHEN split_part(source_file, '-', 1) = 'Thursday' THEN 'validation'
            WHEN split_part(source_file, '-', 1) = 'Friday' THEN 'test' END AS source_partition
FROM raw_orders GROUP BY ALL""")
def q_assign_partition(spark: SparkSession, sf: str) -> DataFrame:
    r = A.raw_orders(spark, sf).withColumn("source_partition", assign_partition(day_from_file("source_file"),
                                                                               DEFAULT_ASSIGNMENT))
    return r.groupBy("source_file", "source_partition").agg(F.count(F.lit(1)).alias("rows"))


@register("temporal_split", ORDERS + """,
lab AS (SELECT source_file, split_part(line, ',', 10) AS label FROM raw_orders)
SELECT CASE WHEN split_part(source_file, '-', 1) IN ('Monday','Tuesday','Wednesday') THEN 'train'
            WHEN split_part(source_file, '-', 1) = 'Thursday' THEN 'validation' ELSE 'test' END AS source_partition,
       count(*) AS rows, count(DISTINCT source_file) AS files, array_to_string(list_sort(list_distinct(list(label))), '|') AS label_coverage
FROM lab GROUP BY ALL""")
def q_temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.raw_orders(spark, sf)
    cells, _ = C.split_columns(F.col("line"), 10)
    r = raw.select("source_file", cells[9].alias("label")).withColumn(
        "source_partition", assign_partition(day_from_file("source_file"), DEFAULT_ASSIGNMENT))
    return r.groupBy("source_partition").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("source_file").alias("files"),
        F.array_join(F.array_sort(F.collect_set("label")), "|").alias("label_coverage"))


@register("label_to_target", FLOWS + """
SELECT original_label, CAST(CASE WHEN original_label = 'BENIGN' THEN 0 WHEN original_label IN """ + O.KNOWN_LABELS_SQL + """
       THEN 1 END AS DOUBLE) AS target, original_label IN """ + O.KNOWN_LABELS_SQL + """ AS known_label, count(*) AS rows
FROM parsed_all GROUP BY ALL""")
def q_label_to_target(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.raw_flows(spark, sf)
    cells, _ = C.split_columns(F.col("line"), 5)
    lab = raw.select(F.trim(cells[4]).alias("original_label"))
    return lab.groupBy("original_label").agg(F.count(F.lit(1)).alias("rows")).select(
        "original_label", label_to_target("original_label").cast("double").alias("target"),
        is_known_label("original_label").alias("known_label"), "rows")


@register("known_label_filter", FLOWS + """
SELECT source_file, count(*) AS unknown_label_rows FROM parsed_all
WHERE original_label NOT IN """ + O.KNOWN_LABELS_SQL + """ GROUP BY ALL""")
def q_known_label_filter(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.raw_flows(spark, sf)
    cells, _ = C.split_columns(F.col("line"), 5)
    known = spark.createDataFrame([(x,) for x in __import__("kestrel.functions", fromlist=["x"]).FIXED_KNOWN_LABELS],
                                  "original_label string")
    lab = raw.select("source_file", F.trim(cells[4]).alias("original_label"))
    # the known-label list is a fixed literal (15 rows): broadcasting it is bounded by construction
    unknown = lab.join(F.broadcast(known), "original_label", "left_anti")
    return unknown.groupBy("source_file").agg(F.count(F.lit(1)).alias("unknown_label_rows"))


@register("coerce_numeric", ORDERS + """
SELECT source_row_number, split_part(line, ',', 3) AS cell, """ + O.coerce_sql("split_part(line, ',', 3)") + """ AS value
FROM raw_orders""")
def q_coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.raw_orders(spark, sf)
    cells, _ = C.split_columns(F.col("line"), 10)
    return raw.select("source_row_number", cells[2].alias("cell"), coerce_numeric(cells[2]).alias("value"))


@register("is_finite_row", ORDERS + """,
vals AS (SELECT source_file, """ + O.coerce_sql("split_part(line, ',', 2)") + """ AS cust,
                """ + O.coerce_sql("split_part(line, ',', 3)") + """ AS price FROM raw_orders)
SELECT source_file, count(*) FILTER (WHERE """ + O.finite_sql("cust") + " AND " + O.finite_sql("price") + """) AS finite_rows,
       count(*) FILTER (WHERE NOT (""" + O.finite_sql("cust") + " AND " + O.finite_sql("price") + """)) AS non_finite_rows
FROM vals GROUP BY ALL""")
def q_is_finite_row(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.raw_orders(spark, sf)
    cells, _ = C.split_columns(F.col("line"), 10)
    v = raw.select("source_file", coerce_numeric(cells[1]).alias("cust"), coerce_numeric(cells[2]).alias("price"))
    ok = is_finite("cust") & is_finite("price")
    return v.groupBy("source_file").agg(F.count_if(ok).alias("finite_rows"), F.count_if(~ok).alias("non_finite_rows"))


@register("token_type", ORDERS + """
SELECT col_index, """ + O.token_sql("cell") + """ AS token_type, count(*) AS cells FROM order_cells GROUP BY ALL""")
def q_token_type(spark: SparkSession, sf: str) -> DataFrame:
    t = P.cells_tall(A.raw_orders(spark, sf), A.ORDER_HEADER)
    return t.groupBy("col_index", token_type("cell").alias("token_type")).agg(F.count(F.lit(1)).alias("cells"))


_PROFILE_SQL = ORDERS + """,
tok AS (SELECT source_file, col_index, column_name, cell, """ + O.token_sql("cell") + """ AS t,
               lower(regexp_replace(cell, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')) AS lo FROM order_cells),
prof AS (
  SELECT COALESCE(source_file, '*') AS source_file, col_index, column_name, count(*) AS rows,
         count(*) FILTER (WHERE t = 'missing') AS missing, count(*) FILTER (WHERE t = 'infinite') AS infinite,
         count(*) FILTER (WHERE t = 'infinite' AND lo IN ('inf', '+inf', 'infinity', '+infinity')) AS pos_inf,
         count(*) FILTER (WHERE t = 'infinite' AND lo NOT IN ('inf', '+inf', 'infinity', '+infinity')) AS neg_inf,
         count(*) FILTER (WHERE t = 'integer') AS integer, count(*) FILTER (WHERE t = 'float') AS float,
         count(*) FILTER (WHERE t = 'string') AS string, min(cell) = max(cell) AS constant,
         CASE WHEN min(cell) = max(cell) THEN min(cell) END AS constant_value
  FROM tok GROUP BY GROUPING SETS ((source_file, col_index, column_name), (col_index, column_name))
)"""


@register("column_profile", _PROFILE_SQL + "\nSELECT * FROM prof")
def q_column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.column_profile(A.raw_orders(spark, sf), A.ORDER_HEADER)


@register("infer_dtype", _PROFILE_SQL + """
SELECT source_file, col_index, column_name,
       CASE WHEN lower(trim(column_name)) = 'label' THEN 'categorical/string target' WHEN string > 0 THEN 'string'
            WHEN float > 0 OR infinite > 0 THEN 'float64-compatible numeric' WHEN integer > 0 THEN 'int64-compatible numeric'
            WHEN missing > 0 THEN 'all missing/empty' ELSE 'unknown/no observed values' END AS dtype_inferred
FROM prof""")
def q_infer_dtype(spark: SparkSession, sf: str) -> DataFrame:
    return P.infer_dtype(P.column_profile(A.raw_orders(spark, sf), A.ORDER_HEADER))


_DOMINANT_SQL = ORDERS + """,
vc AS (SELECT COALESCE(source_file, '*') AS source_file, col_index, column_name, cell, count(*) AS n
       FROM order_cells GROUP BY GROUPING SETS ((source_file, col_index, column_name, cell), (col_index, column_name, cell))),
dom AS (SELECT source_file, col_index, column_name, arg_min(cell, (-n, cell)) AS dominant_value,
               CAST(max(n) AS BIGINT) AS dominant_count, max(n) / sum(n) AS dominant_ratio, max(n) / sum(n) >= 0.995 AS near_constant
        FROM vc GROUP BY ALL)"""


@register("dominant_value", _DOMINANT_SQL + """
SELECT source_file, col_index, column_name, dominant_value, dominant_count, round(dominant_ratio, 6) AS dominant_ratio,
       near_constant FROM dom""")
def q_dominant_value(spark: SparkSession, sf: str) -> DataFrame:
    d = P.dominant_value(A.raw_orders(spark, sf), A.ORDER_HEADER)
    return d.withColumn("dominant_ratio", F.round("dominant_ratio", 6))


@register("duplicate_counts", FLOWS + """
SELECT source_file, CAST(count(*) AS BIGINT) AS rows, count(DISTINCT row_digest) AS unique_row_digests,
       count(*) - count(DISTINCT row_digest) AS duplicate_rows FROM digested GROUP BY source_file
UNION ALL
SELECT '*', count(*), count(DISTINCT row_digest), count(*) - count(DISTINCT row_digest) FROM digested""")
def q_duplicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.duplicate_counts(_flows(spark, sf))


@register("label_inventory", ORDERS + """,
lab AS (SELECT source_file, trim(split_part(line, ',', 10)) AS label FROM raw_orders),
per AS (SELECT COALESCE(source_file, '*') AS source_file, label, count(*) AS rows FROM lab
        GROUP BY GROUPING SETS ((source_file, label), (label)))
SELECT source_file, label, rows, CASE WHEN label = 'BENIGN' THEN 'BENIGN' ELSE 'ATTACK' END AS binary_class,
       round(rows / sum(rows) OVER (PARTITION BY source_file), 6) AS share
FROM per""")
def q_label_inventory(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.raw_orders(spark, sf)
    cells, _ = C.split_columns(F.col("line"), 10)
    inv = P.label_inventory(raw.select("source_file", cells[9].alias("label")))
    return inv.withColumn("share", F.round("share", 6))


@register("attack_types_by_file", ORDERS + """,
lab AS (SELECT source_file, trim(split_part(line, ',', 10)) AS label FROM raw_orders)
SELECT source_file, array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE label <> 'BENIGN'))), '|') AS attack_types,
       array_to_string(list_sort(list_distinct(list(label))), '|') AS labels_present
FROM lab GROUP BY source_file""")
def q_attack_types(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.raw_orders(spark, sf)
    cells, _ = C.split_columns(F.col("line"), 10)
    per = raw.select("source_file", F.trim(cells[9]).alias("label")).groupBy("source_file", "label").agg(
        F.count(F.lit(1)).alias("rows"))
    a = P.attack_types_by_file(per)
    return a.select("source_file", F.array_join("attack_types", "|").alias("attack_types"),
                    F.array_join("labels_present", "|").alias("labels_present"))


def _order_review(spark, sf):
    raw = A.raw_orders(spark, sf)
    summaries = P.S.column_summaries(raw, len(A.ORDER_HEADER))
    prof = P.column_profile(raw, A.ORDER_HEADER, summaries)
    dom = P.dominant_value(raw, A.ORDER_HEADER, summaries=summaries)
    heads = A.order_headers(raw)
    first = heads.filter(F.col("source_file").startswith("Monday"))
    dups = P.duplicate_names(first)
    return P.review_columns(prof, dom, dups)


@register("review_columns", _DOMINANT_SQL + """,
prof AS (SELECT col_index, min(cell) = max(cell) AS constant FROM order_cells GROUP BY col_index),
dups AS (SELECT trim(column_name) AS trimmed_name FROM order_header GROUP BY 1 HAVING count(*) > 1),
j AS (SELECT h.col_index, h.column_name, trim(h.column_name) AS trimmed_name, p.constant, d.near_constant, d.dominant_ratio,
             dd.trimmed_name IS NOT NULL AS dup
      FROM order_header h JOIN prof p USING (col_index) JOIN dom d ON d.col_index = h.col_index AND d.source_file = '*'
      LEFT JOIN dups dd ON dd.trimmed_name = trim(h.column_name)),
r AS (SELECT col_index, column_name, trimmed_name,
             list_sort(list_distinct(list_filter([
               CASE WHEN trimmed_name = 'Destination Port' THEN 'network endpoint/service attribute can encode scenario identity' END,
               CASE WHEN dup THEN 'duplicate column name appears at multiple positions' END,
               CASE WHEN constant THEN 'constant across all discovered raw files' END,
               CASE WHEN NOT constant AND near_constant THEN 'near-constant at ' || printf('%.4f', dominant_ratio * 100) || '%' END,
               CASE WHEN contains(lower(trimmed_name), 'label') OR contains(lower(trimmed_name), 'class')
                         OR contains(lower(trimmed_name), 'attack') THEN 'target-like name; keep out of feature matrix' END
             ], lambda x: x IS NOT NULL))) AS reasons FROM j)
SELECT col_index, column_name, trimmed_name, array_to_string(reasons, '|') AS reasons FROM r WHERE len(reasons) > 0""")
def q_review_columns(spark: SparkSession, sf: str) -> DataFrame:
    r = _order_review(spark, sf)
    return r.select("col_index", "column_name", "trimmed_name", F.array_join("reasons", "|").alias("reasons"))


@register("size_estimate", ORDERS + """
SELECT source_file, count(*) AS rows, count(*) * 9 * 8 AS dense_float64_bytes,
       round(count(*) * 9 * 8 / (1024 * 1024), 3) AS dense_float64_mb FROM raw_orders GROUP BY ALL""")
def q_size_estimate(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.raw_orders(spark, sf).groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    return P.size_estimate(rows, len(A.ORDER_HEADER))


@register("header_check", ORDERS + """,
files AS (SELECT DISTINCT source_file FROM raw_orders),
hdr AS (SELECT f.source_file, h.col_index,
               CASE WHEN starts_with(f.source_file, 'Friday') AND h.col_index = 2 THEN trim(h.column_name) ELSE h.column_name END
                 AS column_name FROM files f, order_header h),
ref AS (SELECT list(column_name ORDER BY col_index) AS r FROM order_header),
per AS (SELECT source_file, list(column_name ORDER BY col_index) AS m FROM hdr GROUP BY source_file)
SELECT source_file, len(m) AS column_count, m = r AS exact_header_match,
       list_transform(m, lambda x: trim(x)) = list_transform(r, lambda x: trim(x)) AS trimmed_header_match,
       array_to_string(list_distinct(list_filter(r, lambda x: NOT list_contains(m, x))), '|') AS missing_from_reference,
       array_to_string(list_distinct(list_filter(m, lambda x: NOT list_contains(r, x))), '|') AS extra_vs_reference,
       len(list_filter(m, lambda x: length(x) <> length(trim(x)))) AS whitespace_padded_names
FROM per, ref""")
def q_header_check(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.raw_orders(spark, sf)
    return P.header_check(A.order_headers(raw), A.ORDER_HEADER)


@register("canonical_name", ORDERS + """
SELECT DISTINCT h.col_index, h.column_name,
  CASE WHEN lower(trim(regexp_replace(regexp_replace(replace(trim(h.column_name), '/', ' per '), '[^0-9A-Za-z]+', '_', 'g'),
       '^_+|_+$', '', 'g'))) = '' THEN 'unnamed'
       ELSE lower(regexp_replace(regexp_replace(replace(trim(h.column_name), '/', ' per '), '[^0-9A-Za-z]+', '_', 'g'),
       '^_+|_+$', '', 'g')) END AS canonical
FROM (SELECT col_index, column_name FROM order_header
      UNION SELECT col_index, trim(column_name) FROM order_header WHERE col_index = 2
            AND EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '5-LOW')) h""")
def q_canonical_name(spark: SparkSession, sf: str) -> DataFrame:
    heads = A.order_headers(A.raw_orders(spark, sf))
    return heads.select("col_index", "column_name", canonical_name("column_name").alias("canonical")).distinct()


@register("column_plan", ORDERS + """,
prof AS (SELECT col_index, min(cell) = max(cell) AS constant FROM order_cells GROUP BY col_index),
c AS (SELECT h.col_index, h.column_name, lower(regexp_replace(regexp_replace(replace(trim(h.column_name), '/', ' per '),
             '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS canonical, p.constant
      FROM order_header h JOIN prof p USING (col_index)),
o AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY col_index) AS occurrence FROM c)
SELECT col_index, column_name, CASE WHEN occurrence > 1 THEN canonical || '_pos_' || CAST(col_index AS VARCHAR) ELSE canonical END
         AS canonical_name,
       CASE WHEN lower(trim(column_name)) = 'label' THEN 'target' WHEN occurrence > 1 THEN 'drop_duplicate'
            WHEN constant THEN 'drop_constant' ELSE 'keep' END AS action
FROM o""")
def q_column_plan(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.raw_orders(spark, sf)
    first = A.order_headers(raw).filter(F.col("source_file").startswith("Monday")).drop("source_file")
    return P.column_plan(first, P.column_profile(raw, A.ORDER_HEADER))


@register("hash_sample", FLOWS + """
SELECT source_partition, count(*) AS rows FROM processed GROUP BY ALL""")
def q_hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    p = A.flows_processed(spark, sf)
    return p.groupBy("source_partition").agg(F.count(F.lit(1)).alias("rows"))


@register("reference_membership", FLOWS + """
SELECT row_digest FROM cleaned WHERE source_partition = 'train'
  AND (('0x' || substr(sha256('reference:' || row_digest), 1, 16))::UBIGINT % 1000000) < 100000""")
def q_reference_membership(spark: SparkSession, sf: str) -> DataFrame:
    p = A.flows_processed(spark, sf).filter(F.col("source_partition") == "train")
    return p.filter(reference_member(F.col("row_digest"))).select("row_digest")


@register("class_counts", FLOWS + """
SELECT source_partition, CAST(target AS INTEGER) AS target, count(*) AS row_count FROM processed GROUP BY ALL""")
def q_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = A.flows_processed(spark, sf).withColumn("target", F.col("target").cast("int"))
    return V.class_counts(p, "target", ["source_partition"])


@register("class_balance", FLOWS + """
SELECT source_partition, count(*) FILTER (WHERE target = 0) AS negatives, count(*) FILTER (WHERE target = 1) AS positives,
       count(*) AS rows,
       round(greatest(count(*) FILTER (WHERE target = 0), 1) / greatest(count(*) FILTER (WHERE target = 1), 1), 6) AS scale_pos_weight,
       round(count(*) / (2.0 * count(*) FILTER (WHERE target = 0)), 6) AS weight_benign,
       round(count(*) / (2.0 * count(*) FILTER (WHERE target = 1)), 6) AS weight_attack
FROM processed GROUP BY ALL""")
def q_class_balance(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.operators.metrics import class_balance
    b = class_balance(A.flows_processed(spark, sf), "target", ["source_partition"])
    return b.select("source_partition", "negatives", "positives", "rows",
                    *[F.round(c, 6).alias(c) for c in ("scale_pos_weight", "weight_benign", "weight_attack")])


@register("head_per_file", FLOWS + """
SELECT source_file, source_row_number, line
FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY source_row_number) AS k FROM raw_flows) WHERE k <= 100""")
def q_head_per_file(spark: SparkSession, sf: str) -> DataFrame:
    """The first 100 lines of each file; Spark keeps 100 per file and task before it shuffles."""
    w = Window.partitionBy("source_file").orderBy("source_row_number")
    return (_flows(spark, sf).select("source_file", "source_row_number", "line").withColumn("_k", F.row_number().over(w))
            .where("_k <= 100").drop("_k"))


@register("finite_counts", FLOWS + """
SELECT column_name, null_count, non_finite_count FROM (
  SELECT 'line_number' AS column_name, count(*) FILTER (WHERE line_number IS NULL) AS null_count,
         count(*) FILTER (WHERE line_number IS NOT NULL AND NOT """ + O.finite_sql("line_number") + """) AS non_finite_count FROM parsed_all
  UNION ALL SELECT 'quantity', count(*) FILTER (WHERE quantity IS NULL),
         count(*) FILTER (WHERE quantity IS NOT NULL AND NOT """ + O.finite_sql("quantity") + """) FROM parsed_all
  UNION ALL SELECT 'discount', count(*) FILTER (WHERE discount IS NULL),
         count(*) FILTER (WHERE discount IS NOT NULL AND NOT """ + O.finite_sql("discount") + """) FROM parsed_all
  UNION ALL SELECT 'tax', count(*) FILTER (WHERE tax IS NULL),
         count(*) FILTER (WHERE tax IS NOT NULL AND NOT """ + O.finite_sql("tax") + """) FROM parsed_all)""")
def q_finite_counts(spark: SparkSession, sf: str) -> DataFrame:
    parsed = C.parse_flows(C.with_digest(_flows(spark, sf)), A.FLOW_FEATURES, A.FLOW_LABEL_POSITION)
    return V.finite_counts(parsed, A.FLOW_FEATURES)


@register("validate_numeric", ORDERS + """,
cells AS (SELECT source_file, col_index, cell, """ + O.coerce_sql("cell") + """ AS x FROM order_cells WHERE col_index IN (1, 2, 4, 7))
SELECT source_file, col_index, count(*) AS cells, count(*) FILTER (WHERE x IS NULL) AS not_numeric,
       count(*) FILTER (WHERE x IS NOT NULL AND NOT """ + O.finite_sql("x") + """) AS not_finite,
       count(*) FILTER (WHERE x IS NULL OR NOT """ + O.finite_sql("x") + """) = 0 AS valid
FROM cells GROUP BY ALL""")
def q_validate_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Per file and numeric column: cells that are no number, numbers that are not finite, and the verdict."""
    t = P.cells_tall(A.raw_orders(spark, sf), A.ORDER_HEADER).where(F.col("col_index").isin(1, 2, 4, 7))
    x = coerce_numeric("cell")
    bad = x.isNull() | ~F.coalesce(is_finite(x), F.lit(False))
    return t.groupBy("source_file", "col_index").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(x.isNull()).alias("not_numeric"),
        F.count_if(x.isNotNull() & bad).alias("not_finite"), (F.count_if(bad) == 0).alias("valid"))


_ = (day_order, label_to_target)

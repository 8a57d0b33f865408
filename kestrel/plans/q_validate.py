"""Registered queries: validation rule tables, leakage and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions import FIXED_KNOWN_LABELS
from kestrel.operators import clean as C
from kestrel.operators import validate as V
from kestrel.operators.profile import cells_wide
from kestrel.plans import adapters as A
from kestrel.plans import oracle as O
from kestrel.plans.registry import register

DOCS = O.with_ctes(O.DOC_PARTITIONS)


@register("partition_leakage", DOCS + """,
per AS (SELECT row_digest, list_sort(list_distinct(list(source_partition))) AS parts FROM doc_partitions GROUP BY row_digest),
pairs AS (SELECT a.p AS "left", b.p AS "right" FROM per,
            (SELECT unnest(parts) AS p) a, (SELECT unnest(parts) AS p) b
          WHERE (CASE a.p WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END)
              < (CASE b.p WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END))
SELECT "left", "right", count(*) AS shared_digests FROM pairs GROUP BY ALL""")
def q_partition_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return V.partition_leakage(A.doc_partitions(spark, sf))


@register("digest_intersection", DOCS + """
SELECT row_digest FROM doc_partitions WHERE source_partition = 'train'
INTERSECT SELECT row_digest FROM doc_partitions WHERE source_partition = 'test'""")
def q_digest_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return V.digest_intersection(A.doc_partitions(spark, sf), "train", "test")


@register("reference_subset", O.with_ctes(O.RAW_FLOWS) + """,
rf AS (SELECT DISTINCT source_file FROM processed WHERE source_partition = 'reference'),
tf AS (SELECT DISTINCT source_file FROM processed WHERE source_partition = 'train')
SELECT (SELECT count(*) FROM rf) AS reference_files,
       (SELECT count(*) FROM rf WHERE source_file NOT IN (SELECT source_file FROM tf)) AS outside_train""")
def q_reference_subset(spark: SparkSession, sf: str) -> DataFrame:
    p = A.flows_processed(spark, sf)
    outside = V.reference_subset(p).agg(F.count(F.lit(1)).alias("outside_train"))
    refs = p.filter(F.col("source_partition") == "reference").agg(F.count_distinct("source_file").alias("reference_files"))
    return refs.withColumn("_k", F.lit(1)).join(outside.withColumn("_k", F.lit(1)), "_k").drop("_k")


@register("manifest_diff", O.with_ctes(O.RAW_FLOWS) + """,
exp AS (SELECT unnest(['BENIGN','Bot','DDoS','DoS GoldenEye','DoS Hulk','DoS Slowhttptest','DoS slowloris','FTP-Patator',
        'Heartbleed','Infiltration','PortScan','SSH-Patator','Web Attack � Brute Force','Web Attack � Sql Injection',
        'Web Attack � XSS']) AS label),
obs AS (SELECT DISTINCT original_label AS label FROM parsed_all)
SELECT COALESCE(e.label, o.label) AS label,
       CASE WHEN e.label IS NOT NULL AND o.label IS NOT NULL THEN 'ok' WHEN e.label IS NOT NULL THEN 'missing' ELSE 'unexpected' END
         AS status
FROM exp e FULL JOIN obs o ON e.label = o.label""")
def q_manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.raw_flows(spark, sf)
    cells, _ = C.split_columns(F.col("line"), 5)
    observed = raw.select(F.trim(cells[4]).alias("label"))
    expected = spark.createDataFrame([(x,) for x in FIXED_KNOWN_LABELS], "label string")
    return V.manifest_diff(expected, observed, "label")


@register("name_diff", O.with_ctes(O.RAW_ORDERS) + """,
expected AS (SELECT unnest(['order_key', 'cust_key', 'total_price', 'order_date', 'priority', 'destination_port']) AS name),
actual AS (SELECT DISTINCT lower(regexp_replace(regexp_replace(replace(trim(column_name), '/', ' per '), '[^0-9A-Za-z]+', '_', 'g'),
           '^_+|_+$', '', 'g')) AS name FROM order_header)
SELECT name, 'missing' AS side FROM (SELECT name FROM expected EXCEPT SELECT name FROM actual)
UNION ALL SELECT name, 'extra' FROM (SELECT name FROM actual EXCEPT SELECT name FROM expected)""")
def q_name_diff(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.functions import canonical_name
    heads = A.order_headers(A.raw_orders(spark, sf)).filter(F.col("source_file").startswith("Monday"))
    actual = heads.select(canonical_name("column_name").alias("name")).distinct()
    expected = spark.createDataFrame([(n,) for n in ("order_key", "cust_key", "total_price", "order_date", "priority",
                                                     "destination_port")], "name string")
    missing = expected.exceptAll(actual).distinct().withColumn("side", F.lit("missing"))
    extra = actual.exceptAll(expected).distinct().withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


@register("validate_processed", O.with_ctes(O.RAW_FLOWS) + """,
st AS (SELECT source_partition, count(*) AS row_count, count(*) FILTER (WHERE target NOT IN (0, 1)) AS bad_target,
              count(*) - count(DISTINCT row_digest) AS dup_digest,
              count(*) - count(DISTINCT (line_number, quantity, discount, tax, target)) AS dup_ft
       FROM processed GROUP BY ALL),
leak AS (SELECT count(*) AS n FROM (SELECT row_digest FROM processed WHERE source_partition IN ('train','validation','test')
         GROUP BY row_digest HAVING count(DISTINCT source_partition) > 1)),
outside AS (SELECT count(*) AS n FROM (SELECT DISTINCT source_file FROM processed WHERE source_partition = 'reference'
            EXCEPT SELECT DISTINCT source_file FROM processed WHERE source_partition = 'train'))
SELECT 'leaked_feature_columns' AS rule, 'schema' AS scope, 'failure' AS severity, true AS passed, '' AS detail
UNION ALL SELECT 'missing_columns', 'schema', 'failure', true, ''
UNION ALL SELECT 'non_numeric_features', 'schema', 'failure', true, ''
UNION ALL SELECT 'target_domain', source_partition, 'failure', bad_target = 0, CAST(bad_target AS VARCHAR) FROM st
UNION ALL SELECT 'minimum_rows', source_partition, 'failure', row_count >= 1, CAST(row_count AS VARCHAR) FROM st
UNION ALL SELECT 'missing_feature_values', source_partition, 'failure', true, '0' FROM st
UNION ALL SELECT 'infinite_feature_values', source_partition, 'failure', true, '0' FROM st
UNION ALL SELECT 'duplicate_raw_observations', source_partition, 'failure', dup_digest = 0, CAST(dup_digest AS VARCHAR) FROM st
UNION ALL SELECT 'duplicate_feature_target_rows', source_partition, 'info', true, CAST(dup_ft AS VARCHAR) FROM st
UNION ALL SELECT 'cross_partition_leakage', 'train|validation|test', 'failure', n = 0, CAST(n AS VARCHAR) FROM leak
UNION ALL SELECT 'reference_subset_of_train', 'reference', 'failure', n = 0, CAST(n AS VARCHAR) FROM outside""")
def q_validate_processed(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.session import materialize

    # the rules read the processed table six times: validate a written copy, as the pipeline does
    # (partitions are published, then validated)
    return V.validate_processed(materialize(A.flows_processed(spark, sf)), A.FLOW_FEATURES)


@register("validate_raw", O.with_ctes(O.RAW_ORDERS) + """,
pf AS (SELECT source_file, count(*) AS rows,
              count(*) FILTER (WHERE trim(split_part(line, ',', 10)) NOT IN """ + O.KNOWN_LABELS_SQL + """) AS unknown_labels,
              count(*) FILTER (WHERE len(string_split(line, ',')) <> 10) AS length_mismatch,
              count(*) FILTER (WHERE split_part(line, ',', 8) <> split_part(line, ',', 9)) AS dup_mismatch
       FROM raw_orders GROUP BY ALL),
hdr AS (SELECT f.source_file, h.col_index,
               CASE WHEN starts_with(f.source_file, 'Friday') AND h.col_index = 2 THEN trim(h.column_name) ELSE h.column_name END
                 AS column_name FROM (SELECT DISTINCT source_file FROM raw_orders) f, order_header h),
ref AS (SELECT list(column_name ORDER BY col_index) AS r FROM order_header),
hc AS (SELECT source_file, m = r AS exact_match,
              list_transform(m, lambda x: trim(x)) = list_transform(r, lambda x: trim(x)) AS trimmed_match,
              array_to_string(list_distinct(list_filter(m, lambda x: NOT list_contains(r, x))), '|') AS extra,
              len(list_filter(m, lambda x: length(x) <> length(trim(x)))) AS padded
       FROM (SELECT source_file, list(column_name ORDER BY col_index) AS m FROM hdr GROUP BY source_file), ref),
exp AS (SELECT unnest(['Monday-Orders-1-URGENT.pcap_ISCX.csv', 'Tuesday-Orders-2-HIGH.pcap_ISCX.csv',
                       'Wednesday-Orders-3-MEDIUM.pcap_ISCX.csv', 'Thursday-Orders-4-NOT_SPECIFIED.pcap_ISCX.csv',
                       'Friday-Orders-5-LOW.pcap_ISCX.csv', 'Saturday-Orders-6-EXTRA.pcap_ISCX.csv']) AS source_file)
SELECT 'minimum_rows' AS rule, source_file AS scope, 'failure' AS severity, rows >= 1 AS passed, CAST(rows AS VARCHAR) AS detail FROM pf
UNION ALL SELECT 'known_labels', source_file, 'failure', unknown_labels = 0, CAST(unknown_labels AS VARCHAR) FROM pf
UNION ALL SELECT 'row_lengths', source_file, 'warning', length_mismatch = 0, CAST(length_mismatch AS VARCHAR) FROM pf
UNION ALL SELECT 'duplicate_column_equal', source_file, 'failure', dup_mismatch = 0, CAST(dup_mismatch AS VARCHAR) FROM pf
UNION ALL SELECT 'header_trimmed_match', source_file, 'failure', trimmed_match, extra FROM hc
UNION ALL SELECT 'header_exact_match', source_file, 'warning', exact_match, CAST(padded AS VARCHAR) FROM hc
UNION ALL SELECT 'expected_files', source_file, 'failure', false, 'missing' FROM exp WHERE source_file NOT IN (SELECT source_file FROM pf)""")
def q_validate_raw(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.raw_orders(spark, sf)
    wide = cells_wide(raw, len(A.ORDER_HEADER))
    expected = ["Monday-Orders-1-URGENT.pcap_ISCX.csv", "Tuesday-Orders-2-HIGH.pcap_ISCX.csv",
                "Wednesday-Orders-3-MEDIUM.pcap_ISCX.csv", "Thursday-Orders-4-NOT_SPECIFIED.pcap_ISCX.csv",
                "Friday-Orders-5-LOW.pcap_ISCX.csv", "Saturday-Orders-6-EXTRA.pcap_ISCX.csv"]
    return V.validate_raw(wide, A.order_headers(raw), A.ORDER_HEADER, 9, FIXED_KNOWN_LABELS, expected, (7, 8))

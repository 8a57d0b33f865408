"""Registered queries: name -> (spark builder, oracle SQL).

Every query reads the driver's tables (through an adapter) in full; the SQL twin
rebuilds the same result in DuckDB from the same parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import validate as V
from kestrel.plans import adapters as A
from kestrel.plans import oracle as O

from kestrel.plans.registry import QUERIES, SQL, register  # noqa: F401


# ---- step 0: prepare -> partition statistics ----------------------------------------------------
@register("partition_stats", O.with_ctes(O.RAW_FLOWS) + """,
dups AS (SELECT source_partition, CAST(sum(n - 1) AS BIGINT) AS duplicate_raw_observation_rows
         FROM (SELECT source_partition, row_digest, count(*) AS n FROM processed GROUP BY ALL) GROUP BY ALL),
fdups AS (SELECT source_partition, CAST(sum(n - 1) AS BIGINT) AS duplicate_feature_target_rows
          FROM (SELECT source_partition, line_number, quantity, discount, tax, target, count(*) AS n
                FROM processed GROUP BY ALL) GROUP BY ALL)
SELECT p.source_partition, count(*) AS row_count,
       count(*) FILTER (WHERE target = 0) AS benign_rows, count(*) FILTER (WHERE target = 1) AS attack_rows,
       array_to_string(list_sort(list_distinct(list(source_file))), ',') AS source_files,
       CAST(sum((line_number IS NULL OR isnan(line_number))::INT + (quantity IS NULL OR isnan(quantity))::INT
                + (discount IS NULL OR isnan(discount))::INT + (tax IS NULL OR isnan(tax))::INT) AS BIGINT)
         AS missing_feature_values,
       CAST(sum((abs(line_number) = 'Infinity'::DOUBLE)::INT + (abs(quantity) = 'Infinity'::DOUBLE)::INT
                + (abs(discount) = 'Infinity'::DOUBLE)::INT + (abs(tax) = 'Infinity'::DOUBLE)::INT) AS BIGINT)
         AS infinite_feature_values,
       any_value(d.duplicate_raw_observation_rows) AS duplicate_raw_observation_rows,
       any_value(f.duplicate_feature_target_rows) AS duplicate_feature_target_rows
FROM processed p JOIN dups d USING (source_partition) JOIN fdups f USING (source_partition)
GROUP BY p.source_partition""")
def q_partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.partition_stats(A.flows_processed(spark, sf_dir), A.FLOW_FEATURES)


# registered query modules (import order = catalog order)
from kestrel.plans import q_metrics  # noqa: E402,F401
from kestrel.plans import q_prepare  # noqa: E402,F401
from kestrel.plans import q_validate  # noqa: E402,F401
from kestrel.plans import q_serving  # noqa: E402,F401
from kestrel.plans import q_monitor  # noqa: E402,F401
from kestrel.plans import q_retrain  # noqa: E402,F401
from kestrel.plans import q_lifecycle  # noqa: E402,F401
from kestrel.plans import q_probation  # noqa: E402,F401
from kestrel.plans import q_ops  # noqa: E402,F401
from kestrel.plans import q_dataset  # noqa: E402,F401
from kestrel.plans import q_ml  # noqa: E402,F401
from kestrel.plans import q_stream  # noqa: E402,F401
from kestrel.plans import q_io  # noqa: E402,F401

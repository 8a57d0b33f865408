"""kestrel: model-data operators for binary-classifier pipelines on Spark.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from Spark SQL
expressions, so Catalyst plans, prunes and pushes down the work. Submodules:

* ``functions`` - Column-level scalar helpers (digests, coercion, metrics maths)
* ``sources``   - readers and writers (raw lines, Parquet partitions, JSONL queues)
* ``operators`` - table operators (cleaning, profiles, metrics, drift, labels, decisions)
* ``streaming`` - Structured Streaming jobs over the same operators
* ``plans``     - adapters from the driver's tables and the registered query catalog
"""

__all__ = ["functions", "sources", "operators", "streaming", "plans"]

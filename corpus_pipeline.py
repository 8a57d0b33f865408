"""The corpus pipeline: toxicity filter, near-duplicate join, substring dedup, benchmark
decontamination, packing. Each stage's result is written as Parquet and read again as the next
stage's documents; all but the last have the columns of ``documents``.

No DuckDB twin (a trained network and a fitted latent space are not SQL): the stages are tested
against brute force in tests/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm.common import read, written
from kestrel.llm.jaccard_join import dedup_stage as near_duplicates
from kestrel.llm.lsa_decontam import decontamination_stage
from kestrel.llm.packing import packing_stage
from kestrel.llm.suffix_dedup import dedup_stage as repeated_strings
from kestrel.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

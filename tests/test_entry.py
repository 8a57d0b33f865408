import duckdb

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def test_entry_runs_at_smoke_scale(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "row_count" in df.columns


def test_every_query_has_a_builder_and_oracles_are_strings():
    q, s = entry.queries(), entry.oracle_sql()
    assert len(q) > 100 and set(s) <= set(q)
    assert all(isinstance(v, str) and v.strip() for v in s.values())


def test_selected_queries_match_duckdb_at_smoke_scale(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ["partition_stats", "psi", "average_precision", "merge_labels", "validate_features", "retrain_trigger"]:
        got = entry.queries()[name](spark, sf).toPandas()
        want = con.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert len(got) == len(want), name

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from kestrel.operators import clean as C
from kestrel.sources.files import scan_raw_lines

HEAD = "Bytes Out, Bytes In,Mean Gap ,Retries, Verdict"
FEATURES = ["bytes_out", "bytes_in", "mean_gap", "retries"]
VERDICT = len(FEATURES)
#: capture file -> its lines; one line comes twice in a file, one again in a later file, one is not finite
CAPTURES = {
    "Monday-north.csv": ["900,17,0.5,0,BENIGN", "12,4,2.25,1,BENIGN", "900,17,0.5,0,BENIGN"],
    "Tuesday-north.csv": ["77,7,inf,2,BENIGN", "3100,0,0.01,9,SSH-Patator"],
    "Wednesday-south.csv": ["64,64,1e-3,5,DoS slowloris", "12,4,2.25,2,BENIGN"],
    "Thursday-north.csv": ["5,5,5,5,Bot"],
    "Friday-north.csv": ["12,4,2.25,1,BENIGN", "8,1,0.125,0,BENIGN"],
    "Friday-south.csv": ["41,2,7.5,3,PortScan"],
}


@pytest.fixture
def captures(tmp_path):
    for name, lines in CAPTURES.items():
        (tmp_path / name).write_bytes("".join(f"{line}\r\n" for line in [HEAD, *lines]).encode())
    return str(tmp_path)


def test_lines_keep_their_numbers_and_text(spark, captures):
    got = {(r["source_file"], r["source_row_number"]): r["line"] for r in scan_raw_lines(spark, captures).collect()}
    assert got == {(name, i): line for name, lines in CAPTURES.items() for i, line in enumerate(lines, 1)}


def test_lines_that_are_not_utf8_keep_their_bytes(spark, tmp_path):
    lines = [b"1,caf\xe9", b"2,\xff\xfe\r", b"3,ok"]
    (tmp_path / "Monday-odd.csv").write_bytes(b"h\n" + b"\n".join(lines) + b"\n")
    got = scan_raw_lines(spark, str(tmp_path)).select(F.hex(F.col("line").cast("binary")).alias("h")).collect()
    assert sorted(r["h"] for r in got) == sorted(line.removesuffix(b"\r").hex().upper() for line in lines)


def test_captures_to_partitions(spark, captures):
    raw = scan_raw_lines(spark, captures)
    removed = C.removal_counts(raw, FEATURES, VERDICT).collect()
    assert sum(r["duplicate_rows"] for r in removed) == 2 and sum(r["invalid_numeric_rows"] for r in removed) == 1
    done = C.prepare_flows(raw, FEATURES, VERDICT, reference_fraction=1.0)
    size = dict(done.groupBy("source_partition").count().collect())
    # the first copy in capture order stays: Monday's, so Friday keeps two of its three lines
    assert size == {"train": 5, "validation": 1, "test": 2, "reference": 5}
    part = lambda name: {r["row_digest"] for r in done.where(F.col("source_partition") == name).collect()}
    assert part("reference") == part("train") and not part("train") & (part("validation") | part("test"))


def test_prepare_is_invariant_to_partitioning(spark):
    import sys
    from pathlib import Path
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from kestrel.operators.validate import partition_stats
    from kestrel.plans import adapters as A

    raw = A.raw_flows(spark, "/root/testdata/sf0.001")
    a = partition_stats(C.prepare_flows(raw, A.FLOW_FEATURES, 4), A.FLOW_FEATURES).collect()
    b = partition_stats(C.prepare_flows(raw.repartition(7), A.FLOW_FEATURES, 4), A.FLOW_FEATURES).collect()
    c = partition_stats(C.prepare_flows(raw.unionByName(raw), A.FLOW_FEATURES, 4), A.FLOW_FEATURES).collect()
    assert sorted(a) == sorted(b)
    # duplicated input files change only the duplicate counters upstream, not the processed partitions
    assert sorted((r.source_partition, r.row_count) for r in a) == sorted((r.source_partition, r.row_count) for r in c)


def test_scan_raw_lines_row_numbers_across_splits(spark):
    d = tempfile.mkdtemp(prefix="kestrel-split-", dir=os.environ.get("KESTREL_SCRATCH", "/tmp"))
    n = 3000
    with open(os.path.join(d, "Monday-Big.pcap_ISCX.csv"), "w") as fh:
        fh.write("h1,h2\n" + "".join(f"{i},{i * 7 % 13}\n" for i in range(1, n + 1)))
    with open(os.path.join(d, "Tuesday-Small.pcap_ISCX.csv"), "w") as fh:
        fh.write("h1,h2\n1,a\n2,b\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")  # force many splits per file
    try:
        raw = scan_raw_lines(spark, d)
        assert raw.rdd.getNumPartitions() > 5
        rows = raw.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    big = sorted((r.source_row_number, r.line) for r in rows if r.source_file.startswith("Monday"))
    assert big == [(i, f"{i},{i * 7 % 13}") for i in range(1, n + 1)]
    small = sorted((r.source_row_number, r.line) for r in rows if r.source_file.startswith("Tuesday"))
    assert small == [(1, "1,a"), (2, "2,b")]

"""Captures in several files."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from kestrel.plans import adapters as A
from kestrel.plans.q_io import write_captures
from kestrel.sources.files import scan_raw_lines

SF = "/root/testdata/sf0.001"


def test_a_large_capture_is_sorted_and_read_in_several_tasks(spark, tmp_path):
    write_captures(spark, SF, f"{tmp_path}/captures", task_rows=500)
    files = glob.glob(f"{tmp_path}/captures/*/*.txt")
    folders = {f.rsplit("/", 1)[0] for f in files}
    assert len(files) > len(folders)
    got = scan_raw_lines(spark, f"{tmp_path}/captures/*/*.txt", folders=True).select(
        F.regexp_extract("source_path", r"source_file=([^/]+)/[^/]+$", 1).alias("f"), "source_row_number", "line").collect()
    rows = A.raw_flows(spark, SF).collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r["source_file"], r["source_row_number"], r["line"])):
        want.setdefault(r["source_file"], []).append(r["line"])
    assert sorted((r["f"], r["source_row_number"], r["line"]) for r in got) == sorted(
        (f, i + 1, line) for f, lines in want.items() for i, line in enumerate(lines))


def test_files_of_their_own_are_numbered_each(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(f"head\n{name}1\n{name}2\n")
    got = scan_raw_lines(spark, f"{tmp_path}/*.csv").select("source_file", "source_row_number", "line").collect()
    assert sorted(map(tuple, got)) == [(f"{n}.csv", i, f"{n}{i}") for n in "ab" for i in (1, 2)]

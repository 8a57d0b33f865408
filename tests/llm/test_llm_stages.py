"""The pipeline and its stages: clashing names, nulls, repeated rows, empty tables, whole characters."""

import random

import pytest

import corpus_pipeline
from kestrel.llm import suffix_dedup as S
from kestrel.llm.compression_quality import scored
from kestrel.llm.jaccard_join import dedup_stage as near_duplicates
from kestrel.llm.lsa_decontam import decontamination_stage
from kestrel.llm.lz_dedup import lz_dedup
from kestrel.llm.packing import packing_stage
from kestrel.llm.quality_rules import judged
from kestrel.llm.suffix_dedup import dedup_stage as repeated_strings
from kestrel.llm.toxicity import classify, toxicity_stage

CLASH = ["kept", "spans", "n_removed", "_doc", "_tag", "_key", "__group__", "a.b", "in_0", "_t", "doc", "score"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WIDE = SCHEMA + ", " + ", ".join(f"`{c}` string" for c in CLASH)
ITEM = "which of the seven harbours of the old league kept its bell tower standing after the flood of spring"


def prose(r, n):
    return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus():
    r = random.Random(11)
    near = prose(r, 150)
    passage = prose(r, 70)
    texts = {i: prose(r, r.randint(60, 200)) for i in range(20)}
    texts[20], texts[21] = near, near                                   # exact copies
    texts[22] = near.rsplit(" ", 1)[0] + " changed"                      # a near copy
    texts[23], texts[24] = prose(r, 80) + " " + passage, passage + " " + prose(r, 90)
    texts[25] = prose(r, 40) + " " + ITEM + " " + prose(r, 40)
    texts[26] = "keep\ufffdme " + passage + " \ufffd"
    texts[27], texts[28] = "", None
    texts[30] = " ".join("vile filth hate " + prose(r, 2) for _ in range(30))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    return rows + [rows[3], rows[3], (None, prose(r, 90), None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(3)
    rows = corpus()
    # the labelled rows: half of them toxic by a few words
    rows += [(1000 + i, " ".join(("vile filth hate " if i % 2 else "") + prose(r, 3) for _ in range(20)), "en", "s", 1) for i in range(160)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, i % 2) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def wide(spark, rows):
    return spark.createDataFrame([(*r, *[f"{c}-{i}" for c in CLASH]) for i, r in enumerate(rows)], WIDE).repartition(3)


STAGES = [near_duplicates, repeated_strings, decontamination_stage, toxicity_stage]


@pytest.mark.parametrize("stage", STAGES)
def test_columns_stay_whatever_their_names(spark, sf, stage):
    rows = corpus()
    got = stage(spark, wide(spark, rows), sf)
    assert got.schema.simpleString() == spark.createDataFrame([], WIDE).schema.simpleString()
    out = [tuple(r) for r in got.collect()]
    own = {r[len(SCHEMA.split(",")):] for r in out}
    assert len(own) == len(out) and own <= {tuple(f"{c}-{i}" for c in CLASH) for i in range(len(rows))}
    ids = [r[0] for r in out]
    if stage is near_duplicates:
        assert {21, 22} & set(ids) == set() and 20 in ids and ids.count(3) == 1 and ids.count(None) == 2
    if stage is decontamination_stage:
        assert set(range(29)) - set(ids) == {25} and ids.count(3) == 3
    if stage is repeated_strings:
        assert len(out) == len(rows)


def operators(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return {"judged": judged, "lz_dedup": lz_dedup, "suffix_dedup": S.suffix_dedup, "scored": lambda d: scored(d, labels),
            "classify": lambda d: classify(d, labels)}


@pytest.mark.parametrize("name, gone, added", [
    ("judged", ["text"], {"kept", "n_words"}), ("lz_dedup", [], {"n_removed", "kept"}), ("suffix_dedup", [], {"n_removed", "spans", "kept"}),
    ("scored", [], {"quality_score"}), ("classify", [], {"toxic_score"})])
def test_operators_pass_columns_of_any_name(spark, sf, name, gone, added):
    rows = corpus()
    docs = wide(spark, rows)
    got = operators(spark, sf)[name](docs)
    assert added <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    stay = [c for c in docs.columns if c not in gone and c in got.columns and c not in
            {"kept", "spans", "n_removed", "n_words", "score"}]
    assert {"a.b", "__group__", "_t", "in_0", "_doc"} <= set(stay)
    cells = lambda df: sorted(str(tuple(r)) for r in df.select(*[f"`{c}`" for c in stay]).collect())
    assert cells(got) == cells(docs)


@pytest.mark.parametrize("stage", [*STAGES, packing_stage])
def test_empty_tables(spark, sf, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).count() == 0


def test_removed_strings_take_whole_characters_and_no_others(spark, sf):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in repeated_strings(spark, docs.where("doc_id >= 23 and doc_id < 29"), sf).collect()}
    assert got[26]["text"].startswith("keep\ufffdm") and got[26]["text"].endswith("\ufffd") and got[26]["n_chars"] < 40
    assert got[28]["text"] is None and got[27]["text"] == ""
    # strings that share all but the first byte of a character
    a, b = "é" + "x" * 60, "\u00a9" + "x" * 60          # C3 A9 and C2 A9
    two = spark.createDataFrame([(1, a, None, None, None), (2, b, None, None, None)], SCHEMA)
    assert {r["doc_id"]: r["text"] for r in repeated_strings(spark, two, sf).collect()} == {1: a, 2: ""}
    kept = {r["doc_id"]: bytes(r["kept"]) for r in S.suffix_dedup(two).collect()}
    assert kept[2] == b"\xc2"


def test_packing_stage_holds_every_piece_once(spark, sf):
    rows = corpus()
    got = packing_stage(spark, wide(spark, rows), sf).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)


def test_run_equals_its_stages(spark, sf):
    """What run() returns, against each stage's rule on what the stage before it kept."""
    got = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in got}
    # toxic rows and copies gone, the benchmark's document gone, the rest there
    assert not {21, 22, 25, 30} & ids
    assert {*range(20), 20, 23, 24, 26, 27, 28} <= ids
    assert sum(r["doc_id"] == 3 for r in got) == 1
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted((str(r["doc_id"]), r["piece"], r["length"]) for r in docs.collect()) == sorted(
        (str(r["doc_id"]), r["piece"], r["length"]) for r in got)

"""Plans and results of the operators that were rebuilt for scale: first-copy dedup, history digests,
file manifests in ranges, draws with replacement."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators import clean as C
from kestrel.operators import profile as P
from kestrel.operators import retrain as RT
from kestrel.operators import sampling as SA
from kestrel.operators import summaries as SU
from kestrel.sources.files import file_manifest


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_copies_in_capture_order(spark):
    r = random.Random(1)
    days = ["Monday", "Friday", "Tuesday", "Saturday"]
    rows = list({(f"{r.choice(days)}-{r.choice('ab')}.csv", i): f"line {r.randint(0, 40)}" for i in range(300)}.items())
    rows = [(f, n, t) for (f, n), t in rows] + [("Monday-a.csv", 1 << 33, None), ("Friday-a.csv", 7, None)]
    raw = spark.createDataFrame(rows, "source_file string, source_row_number long, line string").repartition(5)
    tagged = C.with_digest(raw)
    first = C.dedup_first(tagged)
    assert first.columns == tagged.columns
    order = {"Monday": 1, "Tuesday": 2, "Wednesday": 3, "Thursday": 4, "Friday": 5}
    best = {}
    for f, n, t in rows:
        place = (order.get(f.split("-")[0], 99), f, n)
        best[t] = min(best.get(t, place), place)
    got = {x["line"]: (x["source_file"], x["source_row_number"]) for x in first.collect()}
    assert got == {t: (f, n) for t, (_, f, n) in best.items()}


def test_history_is_read_without_a_shuffle(spark):
    r = random.Random(2)
    row = lambda: (float(r.randint(0, 5)), r.choice([0.1, -0.0, 0.0, None]), r.randint(0, 1))
    history = [row() for _ in range(40)]
    production = [(i, *row()) for i in range(200)]
    digests = RT.history_digests(spark.createDataFrame(history, "a double, b double, target int"), ["a", "b"], "target", 6)
    prod = spark.createDataFrame(production, "n long, a double, b double, target int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = RT.cross_source_dedup(digests, prod, ["a", "b"], "target", ["n"])
        assert "SelectedBucketsCount: 6 out of 6" in plan_of(out) and plan_of(out).count("Exchange hashpartitioning(_d1") == 1
        got = sorted(tuple(x) for x in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    same = lambda a, b, t: (a, None if b is None else b + 0.0, t)
    seen, want = {same(*h) for h in history}, []
    for n, *cells in production:
        if same(*cells) not in seen:
            seen.add(same(*cells))
            want.append((n, *cells))
    assert got == sorted(want)


def test_manifest_of_files_of_any_size(spark, tmp_path):
    r = random.Random(3)
    files = {"small.bin": b"\x00\xff\r\n" * 9, "empty.bin": b"", "text.txt": b"a line of text\r\n" * 900,
             "odd.bin": bytes(r.choice([10, 13, 0, 255, 195, 65]) for _ in range(7000)) + b"end",
             "long.bin": bytes(r.randrange(11, 256) for _ in range(5000)) + b"\n\n"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    chunk = 1000
    settings = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    got = {x["relative_path"].split("/")[1]: x for x in file_manifest(spark, str(tmp_path), chunk).collect()}
    assert settings == {k: spark.conf.get(k) for k in settings}
    assert set(got) == set(files)
    for name, content in files.items():
        assert got[name]["size_bytes"] == len(content)
        if len(content) <= chunk:
            assert (got[name]["sha256"], got[name]["ranges"]) == (hashlib.sha256(content).hexdigest(), 1)
            continue
        ranges, at = {}, 0
        for line in content.removesuffix(b"\n").split(b"\n"):
            ranges.setdefault(0 if at <= chunk else -(-at // chunk) - 1, hashlib.sha256()).update(line + b"\n")
            at += len(line) + 1
        said = "\n".join([str(len(content)), *[ranges[k].hexdigest() for k in sorted(ranges)]])
        assert got[name]["sha256"] == hashlib.sha256(said.encode()).hexdigest(), name
        assert got[name]["ranges"] == len(ranges)


@pytest.mark.parametrize("n, fraction", [(50, None), (900, None), (400, 0.8)])
def test_requests_do_not_depend_on_partitions(spark, n, fraction):
    rows = [(f"id-{i}", int(i % 10 == 0), float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, target int, x double")

    def draw(parts):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            return sorted((str(x["draw"]), x["id"]) for x in SA.request_sample(
                df.repartition(parts), n, 5, "id", attack_fraction=fraction).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    got = draw(8)
    assert got == draw(211) and len(got) == n
    hashed = lambda seed, v: int(hashlib.sha256(f"{seed}:{v}".encode()).hexdigest()[:15], 16)
    want = []
    for label, count in [(None, n)] if fraction is None else [(0, n - round(n * fraction)), (1, round(n * fraction))]:
        seed = 5 if label is None else 5 + label
        ids = sorted((hashed(seed, i), i) for i, t, _ in rows if label is None or t == label)
        want += ([("None", i) for _, i in ids[:count]] if len(ids) >= count
                 else [(str(k), ids[hashed(seed, k) % len(ids)][1]) for k in range(count)])
    assert got == sorted(want)


def test_hash_ranks_are_dense(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"))
    assert sorted(x["r"] for x in SA.hash_ranks(df, 3, "id", "r").collect()) == list(range(500))


HEAD = ["hot", "unique", "constant", "odd", "pairs"]


def captured(r, n):
    odd = ["", " NaN ", "?", "+Infinity", "-inf", "1e5", "1.2.3", "-7", "+", "e", "x", "\u212a", "12 ", "\x0b3", "InF", "n/a"]
    rows = []
    for i in range(n):
        hot = "7" if r.random() < 0.4 else str(r.randint(0, 3000))
        cells = [hot, f"u{r.random()}", "same", r.choice(odd), str(i % 500)]
        rows.append((r.choice("abc") + ".csv", ",".join(cells[: r.choice([5, 5, 5, 4, 6])])))
    return rows + [("d.csv", None), ("d.csv", ",,same"), ("a.csv", ",".join("12345678"))]


def test_column_summaries_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(SU, "COUNTERS", 256)
    r = random.Random(9)
    rows = captured(r, 6000)
    raw = spark.createDataFrame(rows, "source_file string, line string").repartition(6)
    prof = P.column_profile(raw, HEAD)
    dom = P.dominant_value(raw, HEAD)
    assert "SortAggregate" not in plan_of(prof) and "SortAggregate" not in plan_of(dom) and "Expand" not in plan_of(prof)
    cells = {}
    for f, line in rows:
        got = (line or "").split(",")
        for i in range(len(HEAD)):
            c = got[i] if i < len(got) else ""
            for name in (f, "*"):
                cells.setdefault((name, i), []).append(c)
    modes = {(x["source_file"], x["col_index"]): (x["dominant_value"], x["dominant_count"]) for x in dom.collect()}
    for k, values in cells.items():
        n = {v: values.count(v) for v in set(values)} if len(set(values)) < 600 else None
        if n is None:
            from collections import Counter
            n = Counter(values)
        assert modes[k] == min(((v, c) for v, c in n.items()), key=lambda x: (-x[1], x[0])), k
    flat = spark.createDataFrame([(f, i, v) for (f, i), vs in cells.items() for v in vs], "source_file string, col_index int, cell string")
    from kestrel.functions import token_type

    want = {(x["source_file"], x["col_index"], x["t"]): x["n"] for x in flat.groupBy("source_file", "col_index", token_type("cell").alias("t"))
            .agg(F.count(F.lit(1)).alias("n")).collect()}
    for x in prof.collect():
        k = (x["source_file"], x["col_index"])
        assert x["rows"] == len(cells[k]) and x["column_name"] == HEAD[k[1]]
        for t in ("missing", "infinite", "integer", "float", "string"):
            assert x[t] == want.get((*k, t), 0), (k, t)
        assert x["pos_inf"] + x["neg_inf"] == x["infinite"]
        one = set(cells[k])
        assert x["constant"] == (len(one) == 1) and x["constant_value"] == (one.pop() if x["constant"] else None)


def test_columns_without_lines(spark):
    raw = spark.createDataFrame([], "source_file string, line string")
    assert P.column_profile(raw, HEAD).count() == 0 and P.dominant_value(raw, HEAD).count() == 0

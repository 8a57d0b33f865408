import random

import pytest

from kestrel.llm import toxicity as T

SCHEMA = "doc_id long, text string, lang string"


def toy(n=400):
    r = random.Random(2)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(5, 200))]
        bad = r.random() < 0.3
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["Zonkest", "zonkish", "zonk###"]))
        docs.append((i, " ".join(w), "en"))
        labels.append((i, 0 if bad else 1, int(bad)))
    return docs, labels


def test_toxicity_learns_and_scores_odd_rows(spark):
    docs, labels = toy()
    odd = [(1000, None, None), (1001, "", "fr"), (None, "zonkish " * 3, None), (1002, "x" * 300_000, "de"), docs[0]]
    df = spark.createDataFrame(docs + odd, SCHEMA)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = T.classify(df.withColumn("toxic_lang", df.lang), lab).collect()
    assert len(out) == len(docs) + len(odd) and all(0 <= r["toxic_score"] <= 1 for r in out)
    truth = {d: y for d, _, y in labels}
    right = [(r["toxic_score"] >= T.LIMIT) == truth[r["doc_id"]] for r in out if r["doc_id"] in truth]
    assert sum(right) / len(right) > 0.97
    assert [r["toxic_score"] for r in out if r["doc_id"] is None][0] >= T.LIMIT
    assert len({r["toxic_score"] for r in out if r["doc_id"] in (1000, 1001)}) == 1


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = T.classify(spark.createDataFrame(toy(5)[0], SCHEMA), none).collect()
    assert [r["toxic_score"] for r in rows] == [0.0] * 5
    assert T.classify(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_toxicity_learns_from_every_labelled_text(spark):
    """Two words: one in the 1 500 toxic texts of least id hash and in none longer than 64 KB, one in the others."""
    from pyspark.sql import functions as F

    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    ids = spark.range(6000).withColumn("h", F.xxhash64("id")).orderBy("h", "id").collect()
    learned = {row["id"] for row in ids if not in_fold(row["id"])}
    toxic = [row["id"] for row in ids if row["id"] % 2 and row["id"] in learned]
    early, docs, labels = set(toxic[:1500]), [], []
    assert len(toxic) > 1800
    for i in range(6000):
        w = [r.choice(vocab) for _ in range(r.randint(5, 30))]
        if i % 2:
            w.insert(r.randrange(len(w)), "zonkest" if i in early else "quorbel")
        docs.append((i, " ".join(w), "en"))
        labels.append((i, 1, i % 2))
    big = "abc " * 20_000
    docs += [(6000 + i, big + ("wixxam" if i % 2 else ""), "en") for i in range(80)]
    labels += [(6000 + i, 1, i % 2) for i in range(80)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, SCHEMA)
    taught = {i for i, _, _ in labels if not in_fold(i)}
    rows = T.training_set(df, lab, "text").select("t", "y").collect()
    assert sorted((bytes(t).decode(), y) for t, y in rows) == sorted((t, y) for (i, t, _), (_, _, y) in zip(docs, labels) if i in taught)
    probes = [(1, "some plain words quorbel here", "en"), (2, "some plain words here", "en"), (3, "some plain words wixxam here", "en"),
              (4, "some plain words zonkest here", "en")]
    net = T.train(df, lab)
    scores, _ = net.scores([t.encode() for _, t, _ in probes])
    assert [s >= T.LIMIT for s in scores] == [True, False, True, True]


def in_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_gradients_match_differences():
    import numpy as np

    net = T.Net()
    ids, begin, _ = T.padded([b"one two three four", b"five", b""])
    y = np.array([1, 0, 0], np.float32)

    def loss():
        z = net.logits(ids, begin).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g, _ = net.gradients(ids, begin, y)
    for name, at in (("W2", (1, 3)), ("out", (5,)), ("b", (0,)), ("c3", (2,))):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-2
        up = loss()
        net.p[name][at] = keep - 1e-2
        down = loss()
        net.p[name][at] = keep
        assert (up - down) / 2e-2 == pytest.approx(float(g[name][at]), abs=2e-3)


def test_quality_learns_and_scores_odd_rows(spark):
    from kestrel.llm import compression_quality as C

    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(500):
        good = r.random() < 0.7
        w = [r.choice(vocab) + ("" if good else r.choice(["###", "$$$"])) for _ in range(r.randint(20, 200))]
        docs.append((i, " ".join(w), "en"))
        labels.append((i, int(good), 0))
    odd = [(1000, None, None), (1001, "", "fr"), (None, "zonk### " * 30, None), (1002, "x" * 300_000, "de"), docs[0]]
    df = spark.createDataFrame(docs + odd, SCHEMA).withColumnRenamed("lang", "quality_score")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = C.scored(df, lab).collect()
    assert len(out) == len(docs) + len(odd) and all(0 <= x["quality_score"] <= 1 for x in out)
    truth = {d: y for d, y, _ in labels}
    right = [(x["quality_score"] >= C.LIMIT) == truth[x["doc_id"]] for x in out if x["doc_id"] in truth]
    assert sum(right) / len(right) > 0.97
    assert len({x["quality_score"] for x in out if x["doc_id"] in (1000, 1001)}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x["quality_score"] for x in C.scored(df.limit(3), none).collect()] == [0.5] * 3
    assert C.scored(spark.createDataFrame([], SCHEMA), lab).count() == 0


def test_quality_judges_all_of_a_long_text(spark):
    from kestrel.llm import compression_quality as C

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    good, bad = [word() for _ in range(500)], [word() for _ in range(500)]
    make = lambda v, n: " ".join(r.choice(v) for _ in range(n))
    scorer = C.Scorer(*[[make(v, 300).encode() for _ in range(150)] for v in (good, bad)])
    text, other = make(good, 30_000).encode(), make(bad, 2000).encode()
    short, long, first, last = scorer.evidence([text[:2000], text, other + b" " + text, text + b" " + other])[:, 0]
    assert long > 0.8 * short and min(first, last) > 0.6 * short and abs(first - last) < 0.05 * short
    # texts longer than MOST_BYTES are learned from: here every one of a class is
    docs = [(i, make(good if i % 2 else bad, 12_000 if i % 2 else 200), "en") for i in range(60)]
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    out = C.scored(spark.createDataFrame(docs + [docs[1]], SCHEMA), lab).collect()
    assert all(len(t) > C.MOST_BYTES for i, t, _ in docs if i % 2)
    assert all((x["quality_score"] >= C.LIMIT) == x["doc_id"] % 2 for x in out)

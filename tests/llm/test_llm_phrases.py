import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kestrel.llm import phrases as P

WORDS = ["a", "The", "fox", "Ünï", "x\x1cy", "é", "z"]


def corpus(seed, n):
    r = random.Random(seed)
    rows = [(r.choice(["en", "de", None]), "".join(r.choice(WORDS) + r.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n"])
                                                   for _ in range(r.randint(0, 60)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, None), rows[0], rows[0],
                   ("en", " ".join(r.choice(WORDS) for _ in range(2000)))]


def runs(rows):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least, top):
    out = []
    f_of, n = runs(rows)
    for lang, f in f_of.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        gone = {g[i:i + m] for g, a in found.items() for m in range(2, len(g)) for i in range(len(g) - m + 1)
                if 100 * a >= 100 * f[g[i:i + m]]}
        best = []
        for g, a in found.items():
            if g not in gone:
                score, k = min((1000 * a * n[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 7, 60])
def test_collocations_equal_brute_force(spark, least):
    rows = corpus(least, 250)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, f int").repartition(5)
    got = P.collocations(P.frequent_phrases(docs, least), least, 40)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, 40)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert P.collocations(P.frequent_phrases(docs, 3), 3, 10).count() == 0


@pytest.mark.parametrize("most", [16, 64, 1 << 20])
def test_each_run_is_counted_once_in_any_cut(most):
    rows = [("en", t) for _, t in corpus(5, 30) if t is not None]
    got = defaultdict(Counter)
    for part in P.batches([t.encode() for _, t in rows], ["en"] * len(rows), most):
        for n, (at, h) in enumerate(part.hashes(), 1):
            got[n].update(part.phrases(at, n).to_pylist())
    want = runs(rows)[0]["en"]
    for n in range(1, 6):
        assert got[n] == Counter({" ".join(g): c for g, c in want.items() if len(g) == n})


def test_summaries_lose_no_frequent_key_and_merge():
    r = np.random.default_rng(1)
    for least in (5, 50, 400):
        keys = r.zipf(1.3, 200_000).astype(np.uint32)
        true = Counter(keys.tolist())
        whole = P.Summary(len(keys), least)
        other = P.Summary(len(keys), least)
        for i, part in enumerate(np.array_split(keys, 40)):
            (whole if i % 2 else other).add(*P.counted(part))
            (whole if i % 2 else other).merge()
        other.merge()
        whole.add(other.keys, other.counts, other.lowered)
        found = set(whole.survivors().tolist())
        assert {k for k, c in true.items() if c >= least} <= found
        assert whole.lowered < least and len(whole.keys) <= whole.capacity
        assert all(true[k] >= least // 2 for k in found)


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    counts = spark.createDataFrame([("en", 0, "", big * 100), ("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)],
                                   "lang string, words int, phrase string, f long")
    (row,) = P.collocations(counts, 100, 10).collect()
    assert row["score"] == 1000 * (big - 1) * big * 100 // (big * (big + 1))

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from kestrel.llm import anchors as A
from kestrel.llm import lz_dedup as L
from kestrel.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, lang string"


def corpus(seed=3):
    """Copies, near copies, shared passages, repeats inside a text, one long text, ties and nulls."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ré", "to", "un"]) for _ in range(r.randint(1, 4)))
    make = lambda n: " ".join(word() for _ in range(n))
    base = [make(r.randint(1, 120)) for _ in range(30)]
    passage, out = make(40), []
    for i, t in enumerate(base):
        out.append(t)
        if i % 5 == 0:
            out += [t, t[:-3] + "x", t.replace("ka", "ke", 1)]
        if i % 4 == 0:
            out.append(make(7) + "\n" + passage + "\t" + make(9))
    out += ["", None, "a" * 300, "a" * 200, "b\n" * 90, make(2000) + passage, passage, "short"]
    r.shuffle(out)
    rows = [(i * 7, t, "en") for i, t in enumerate(out)]
    return rows + [rows[3], (rows[5][0], "other " + passage, None), (None, passage, "de"), (None, passage + " zz", None)]


def brute(rows, units, width, joiner):
    seen: dict = {}
    parsed = []
    for doc, text, _ in rows:
        u = units(text)
        k = doc if doc is not None else (1 << 63) - 1
        parsed.append((k, u))
        for i in range(len(u) - width + 1):
            w = u[i : i + width]
            seen[w] = min(seen.get(w, k), k)
    for k, u in parsed:
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if seen[u[i : i + width]] < k:
                gone[i : i + width] = [True] * width
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = joiner(x for x, g in zip(u, gone) if not g)
        yield len(u), sum(gone), runs, hashlib.sha256(kept).hexdigest()


def words(text):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(spark, op, rows, units, width, joiner, size):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r[size], r["n_removed"], len(r["spans"]),
                  hashlib.sha256(r["kept"] if isinstance(r["kept"], (bytes, bytearray)) else r["kept"].encode()).hexdigest())
                 for r in op(df).collect())
    want = sorted((doc if doc is not None else -1, *b) for (doc, _, _), b in zip(rows, brute(rows, units, width, joiner)))
    assert got == want
    return got


@pytest.mark.parametrize("seed", [3, 4])
def test_byte_strings_match_brute_force(spark, seed):
    got = check(spark, S.suffix_dedup, corpus(seed), lambda t: (t or "").encode(), 50, bytes, "n_bytes")
    assert sum(g[2] for g in got) > 2000


@pytest.mark.parametrize("seed", [3, 4])
def test_word_windows_match_brute_force(spark, seed):
    got = check(spark, L.lz_dedup, corpus(seed), words, 13, lambda w: " ".join(w).encode(), "n_words")
    assert sum(g[2] for g in got) > 300


def test_empty_table_and_clashing_columns(spark):
    for op in (S.suffix_dedup, L.lz_dedup):
        empty = op(spark.createDataFrame([], SCHEMA))
        assert empty.count() == 0 and "n_removed" in empty.columns
        df = spark.createDataFrame([(1, "x " * 40, 5, 7), (2, "x " * 40, 6, 8)], "doc_id long, text string, kept int, bucket int")
        rows = sorted(op(df).collect(), key=lambda r: r["doc_id"])
        assert [r["bucket"] for r in rows] == [7, 8] and rows[1]["n_removed"] > 0 and not rows[0]["n_removed"]


def test_suffix_order_is_a_suffix_array():
    r = np.random.default_rng(1)
    for n, letters, block in ((400, 2, 64), (3000, 3, 500), (500, 1, 100)):
        text = r.integers(97, 97 + letters, n).astype(np.uint8)
        order = np.concatenate(list(S.suffix_order(text, np.arange(n), n, block)))
        raw = text.tobytes()
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(n))


def test_stage_keeps_all_documents_and_columns(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    out = S.dedup_stage(spark, df, "")
    assert out.columns == df.columns and out.count() == len(rows)
    assert all("�" not in (r["text"] or "") for r in out.collect())


def test_surroundings_of_a_common_phrase_do_not_meet_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(A, "MOST_PIECES", 40, raising=False)
    method = L.factor

    def bounded(rows):
        most = max(Counter(r[0] for r in rows).values(), default=0)
        if most > 40:
            raise ValueError(f"{most} pieces of one anchor in a bucket")
        return method(rows)

    monkeypatch.setattr(L, "factor", bounded)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    phrase, rows = " ".join(word() for _ in range(12)), []
    for i in range(400):
        near = [rows[r.randrange(len(rows))][1].split(" ") for _ in range(2)] if i % 3 == 2 else None
        left, right = (near[0][:6], near[1][-6:]) if near else ([word() for _ in range(6)], [word() for _ in range(6)])
        rows.append((i, " ".join([*left, phrase, *right]), "en"))
    rows += [(400, rows[7][1] + " " + rows[7][1], "en"), (7, rows[9][1], "en"), (None, rows[4][1], "en")]
    got = check(spark, L.lz_dedup, rows, words, 13, lambda w: " ".join(w).encode(), "n_words")
    assert sum(g[2] for g in got) > 1500
    check(spark, S.suffix_dedup, rows, lambda t: (t or "").encode(), 50, bytes, "n_bytes")

import random
import re
from collections import Counter

from kestrel.llm import perspectives as P
from kestrel.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, kept string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base(t):
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in t or "")
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def corpus():
    r = random.Random(8)
    out = []
    for i in range(200):
        w = ["".join(r.choice("abcdeé漢") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 160))]
        if i % 9 == 0:
            w = [x + "###" for x in w]
        if i % 7 == 0:
            w = w * 2
        out.append("".join(x + r.choice([" ", " ", "\n", "\t", ". ", "\r\n", "\x0b"]) for x in w))
    return [(i, t, "z") for i, t in enumerate(out + ["", None, " \n\t", "a", "x y", "same line\n" * 60, "w " * 30_000])]


def test_counts_match_brute_force(spark):
    rows = corpus()
    rows += [rows[1], (None, rows[2][1], None)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                  r["n_repeat_words"], r["base_failed"]) for r in Q.judged(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted((d is None, d or 0, *base(t)) for d, t, _ in rows)


def test_posterior_separates_junk_and_base_failures_go(spark):
    r = random.Random(1)
    make = lambda n: " ".join(r.choice(["river", "stone", "and", "the", "walks", "green"]) + str(r.randrange(99)) * (k % 3 == 0)
                              + (". " if k % 12 == 11 else "") for k in range(n))
    rows = [(i, make(200), "") for i in range(150)] + [(1000 + i, make(200).replace(" ", "$$$ "), "") for i in range(15)]
    got = {x["doc_id"]: x for x in Q.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["kept"] for i in range(150)) and not any(got[1000 + i]["kept"] for i in range(15))
    assert not any(x["kept"] and x["base_failed"] for x in got.values())


def test_no_rows(spark):
    assert Q.judged(spark.createDataFrame([], SCHEMA)).count() == 0
    assert P.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_perspectives_match_a_plain_rendering(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 4)
    r = random.Random(3)
    rows = []
    for c in [*range(12), None]:
        for t in range(r.randint(1, 15)):
            rows.append((c, None if r.random() < 0.05 else r.randrange(14), r.choice(["ann", "bob", "system", None]),
                         r.choice(["", None, "hello é", "two\nlines"]), 1))
    rows += [rows[0], (99, 0, "system", "alone", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start int")
    got: dict = {}
    for x in P.perspectives(df).collect():
        got.setdefault((x["conv_id"], x["perspective"]), []).append(x)
    want = {}
    for conv in {x[0] for x in rows}:
        turns = sorted(((t is None, t or 0, s or "unknown", x or "") for c, t, s, x, _ in rows if c == conv))
        for who in {s for _, _, s, _ in turns} - {"system"}:
            text, spans = "", []
            for _, _, s, x in turns:
                head = "<|assistant|>\n" if s == who else "<|system|>\n" if s == "system" else f"<|user|> name={s}\n"
                if s == who:
                    spans.append((len(text + head), len(text + head + x + P.END)))
                text += head + x + P.END
            want[conv, who] = (text, spans, len(turns))
    assert got.keys() == want.keys()
    for key, chunks in got.items():
        chunks.sort(key=lambda x: x["start"])
        assert "".join(x["rendered"] for x in chunks) == want[key][0]
        assert [(x["start"] + m["start"], x["start"] + m["end"]) for x in chunks for m in x["masks"]] == want[key][1]
        assert sum(x["n_turns"] for x in chunks) == want[key][2]

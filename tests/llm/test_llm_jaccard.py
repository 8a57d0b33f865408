import random
import re

from kestrel.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, comp string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t, _ in rows]
    n = len(rows)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, texts = [0] * n, [set() for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                if sets[i] != sets[j]:
                    texts[i].add(frozenset(sets[j]))
                parent[max(root(i), root(j))] = min(root(i), root(j))
    big = 1 << 62
    least: dict = {}
    for i, (d, _, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), big), big if d is None else d)
    key = lambda d: -1 if d is None else d
    return sorted((key(d), -1 if least[root(i)] == big else least[root(i)], links[i], len(texts[i]))
                  for i, (d, _, _) in enumerate(rows))


def corpus(big=30):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    out = []
    for i in range(25):
        w = [r.choice(vocab) for _ in range(r.randint(3, 150))]
        out.append(" ".join(w))
        for _ in range(r.choice([0, 0, 1, 3, big if i == 7 else 2])):
            v = list(w)
            for _ in range(r.randint(0, 3)):
                v[r.randrange(len(v))] = r.choice(vocab)
            out.append("\n".join(v) if r.random() < 0.3 else " ".join(v))
    out += ["", None, "  ", "one", "one", "two words", "x " * 4000, "x " * 30]
    r.shuffle(out)
    rows = [(i * 3, t, "c") for i, t in enumerate(out)]
    return rows + [rows[0], (rows[1][0], "another text with the same id as before", None),
                   (None, rows[2][1], None), (None, "nothing like the others at all", None)]


def run(spark, rows):
    key = lambda x: -1 if x is None else x
    return sorted((key(r.doc_id), key(r.class_id), r.n_links, r.n_texts)
                  for r in J.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect())


def test_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(J, "BLOCK", 8)   # the large group in pairs of blocks
    assert run(spark, rows) == want


def test_empty_table(spark):
    assert J.jaccard_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_depth_follows_the_target():
    assert J.prefix_depth(0.8, 0.98) == 6 and J.prefix_depth(0.8, 0.5) > 6 and J.prefix_depth(0.8, 0.9999) < 6


def test_stage_keeps_one_of_each_class(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, SCHEMA)
    out = J.dedup_stage(spark, df, "")
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect() if r["doc_id"] is not None]
    classes = {c for d, c, _, _ in brute(rows) if d >= 0}
    assert set(kept) >= {c for c in classes if c >= 0} and len(kept) < len(rows)

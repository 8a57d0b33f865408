import numpy as np
import pytest

from kestrel.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score double"


def rows_of(seed, n, dims=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    x = (centres[r.integers(0, 6, n)] + 0.4 * r.normal(size=(n, dims))).astype(np.float32)
    x[r.random(n) < 0.3] = x[0]                       # copies
    out = [(i, x[i].tolist(), int(r.integers(0, 4)), "c", 0.5) for i in range(n)]
    return out + [out[0], out[5], (None, x[1].tolist(), 1, None, None), (100, None, 1, "", 1.0), (200, x[2].tolist(), None, "", 1.0),
                  (300, [1.0, None] + [0.0] * (dims - 2), 1, "", 1.0), (400, [float("nan")] * dims, 1, "", 1.0),
                  (500, [float("inf")] * dims, 1, "", 1.0), (60_000, [], 1, "", 1.0), (60_100, x[3].tolist()[:3], 2, "", 1.0)]


def brute(rows, every):
    use = [(d, np.floor(np.array(x, np.float64) * 256), y) for d, x, y, *_ in rows
           if y is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    width = max(len(x) for _, x, _ in use)
    m = np.array([np.pad(x, (0, width - len(x))) for _, x, _ in use]).astype(np.int64)
    ids = [1 << 62 if d is None else d for d, _, _ in use]
    out = []
    for a, (d, _, y) in enumerate(use):
        if d is None or d % every:
            continue
        s = (m @ m[a]).tolist()
        first = lambda keep: sorted((-s[i], ids[i], i) for i in range(len(use)) if i != a and keep(i))[:5]
        for p, pid, _ in first(lambda i: use[i][2] == y):
            hard = first(lambda i: use[i][2] != y and 80 * -p <= 100 * s[i] <= 100 * -p)
            out += [(d, None if pid == 1 << 62 else pid, k, None if n == 1 << 62 else n, -p, -v) for k, (v, n, _) in enumerate(hard, 1)]
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("block, shares", [(64, 7), (2048, 16_384)])
def test_equal_to_brute_force(spark, monkeypatch, block, shares):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "ANCHORS", shares)
    rows = rows_of(block, 600)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in H.mine(H.usable(df), H.F.col("id") % 20 == 0).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 20), key=key)
    assert len(got) > 100


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert H.mine(H.usable(df), H.F.col("id") % 20 == 0).count() == 0


def test_tree_covers_and_separates():
    x = np.random.default_rng(2).integers(-300, 300, (700, 6))
    x[:50] = x[0]
    tree, order = H.CoverTree.build(x)
    assert sorted(order.tolist()) == list(range(700)) and (x[order] == tree.points).all()
    v = tree.values
    v = np.column_stack([v, np.sqrt(np.maximum(0, tree.longest2 - (v * v).sum(axis=1)))])

    def below(node):
        own = set(range(tree.lo[node], tree.lo[node] + tree.own[node]))
        for c in range(tree.child[node], tree.child[node] + tree.children[node]):
            own |= below(c)
        return own

    for node in range(len(tree.centre)):
        points = sorted(below(node))
        d = np.linalg.norm(v[points] - v[tree.centre[node]], axis=1)
        assert d.max() <= tree.radius[node] * (1 + 1e-9) + 1e-9
        kids = range(tree.child[node], tree.child[node] + tree.children[node])
        for a in kids:
            assert tree.radius[a] <= tree.radius[node] / H.BASE + 1e-9
            for b in kids:
                gap = np.linalg.norm(v[tree.centre[a]] - v[tree.centre[b]])
                assert a == b or gap > tree.radius[node] / H.BASE - 1e-9


def test_scores_of_any_size():
    x = np.array([[1 << 28, 3], [(1 << 28) + 1, -1], [5, 5]], np.int64)
    tree, order = H.CoverTree.build(x)
    got = H.Search(tree, x[0]).best(3, np.ones(3, bool), order)
    assert [(-s, i) for s, i, _ in got] == sorted(((int(x[i] @ x[0]), i) for i in range(3)), reverse=True)
    with pytest.raises(ValueError):
        H.Search(H.CoverTree.build(x << 8)[0], x[0] << 8)

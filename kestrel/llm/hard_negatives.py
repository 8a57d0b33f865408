"""Hard negatives by cover trees over norm-augmented vectors.

Every vector x gets one more component, sqrt(M**2 - |x|**2) with M the longest norm of its block, so
that all points of a block lie on one sphere and a query's inner product falls with its distance:
2 * q.x = |q|**2 + M**2 - d(q, x)**2. A block's points form a cover tree: a node's children are
picked farthest-first until they cover its points within its radius / BASE, the node's own centre
first; points alone in their child stay with the node, and nodes of at most LEAF points or radius 0
(copies) are leaves. The distance to a centre and the radius bound the inner products below a node.
A search opens nodes best first by that bound, skips those whose bounds lie outside its window, and
verifies points by exact integer inner products; it ends when no open node can still enter the best.

Blocks are cut by row, not by label, so a label with a third of all rows is spread. Trees are built
once, written to the shared folder, and meet the anchors (the stated query set) cell by cell: a few
trees and at most ANCHORS anchors. Each cell returns the best few rows of each search; their merge
is a window of that many rows a cell.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part;
an empty vector scores 0, a shorter one counts as padded by 0. A null id is never an anchor and
comes last among ties; repeated rows are rows of their own. Scores that pass 64 bits raise an error.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import NO_ID, read, written

BASE = 2
LEAF = 64
BLOCK = 2048
ANCHORS = 16_384
MOST_TREES = 32


# ---- one tree ---------------------------------------------------------------------------------------
class CoverTree:
    """``points`` in tree order, and nodes: centre, radius, range of points (own verified points first),
    how many of them are the node's own, first child and number of children."""

    FIELDS = ("centre", "radius", "lo", "own", "child", "children")

    def __init__(self, points: np.ndarray, nodes: dict[str, np.ndarray], longest2: float):
        self.points, self.longest2 = points, longest2
        self.values = points.astype(np.float64)
        self.most = float(np.abs(self.values).max(initial=0))
        for f in self.FIELDS:
            setattr(self, f, nodes[f])
        self.centres = self.values[self.centre] if len(self.centre) else self.values[:0]

    @classmethod
    def build(cls, points: np.ndarray) -> tuple["CoverTree", np.ndarray]:
        """The tree and the order of the points in it."""
        x = points.astype(np.float64)
        norm2 = (x * x).sum(axis=1)
        longest2 = float(norm2.max(initial=0))
        x = np.column_stack([x, np.sqrt(longest2 - norm2)])
        order, rows, todo = [], [], []

        def away(i: int, at: np.ndarray) -> np.ndarray:
            # |x|**2 is longest2 for all: no cancellation but in the last bits, and copies at exactly 0
            d = x[at] - x[i]
            return np.sqrt(np.einsum("ij,ij->i", d, d))

        def node(centre: int, at: np.ndarray, dist: np.ndarray) -> None:
            rows.append([centre, float(dist.max(initial=0)), 0, 0, 0, 0])
            todo.append((len(rows) - 1, at, dist))

        if len(x):
            every = np.arange(len(x))
            node(0, every, away(0, every))
        done = 0
        while done < len(todo):
            me, at, dist = todo[done]
            todo[done] = None
            done += 1
            centre, radius = rows[me][0], rows[me][1]
            if radius == 0 or len(at) <= LEAF:
                rows[me][2:4] = len(order), len(at)
                order.extend(at.tolist())
                continue
            best, whose, picked = dist.copy(), np.zeros(len(at), np.int64), [centre]
            while True:
                far = int(best.argmax())
                if best[far] <= radius / BASE:
                    break
                d = away(at[far], at)
                closer = d < best
                best[closer] = d[closer]
                whose[closer] = len(picked)
                picked.append(int(at[far]))
            size = np.bincount(whose, minlength=len(picked))
            alone = at[size[whose] == 1]
            rows[me][2:4] = len(order), len(alone)
            order.extend(alone.tolist())
            rows[me][4] = len(rows)
            grouped = np.argsort(whose, kind="stable")
            ends = np.cumsum(size)
            for k in np.flatnonzero(size > 1):
                part = grouped[ends[k] - size[k]:ends[k]]
                node(picked[k], at[part], best[part])
            rows[me][5] = len(rows) - rows[me][4]
        order = np.array(order, np.int64)
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(order))
        table = np.array(rows, np.float64).reshape(-1, 6)
        nodes = {f: table[:, i] if f == "radius" else table[:, i].astype(np.int64) for i, f in enumerate(cls.FIELDS)}
        nodes["centre"] = place[nodes["centre"]] if len(x) else nodes["centre"]
        return cls(points[order], nodes, longest2), order


class Search:
    """One anchor's searches in one tree; scores found once are kept for its other windows."""

    def __init__(self, tree: CoverTree, query: np.ndarray):
        self.tree = tree
        width = tree.points.shape[1]
        q = np.zeros(width, np.int64)
        q[:min(width, len(query))] = query[:width]
        bound = tree.most * float(np.abs(q).max(initial=0)) * width
        if bound >= 2.0**63:
            raise ValueError("inner products pass 64 bits")
        self.small, self.ints, self.q = bound < 2.0**53, q, q.astype(np.float64)
        whole = query.astype(np.float64)
        self.sum2 = float(whole @ whole) + tree.longest2
        # rounding of distances and radii: far below one unit for all but huge vectors
        self.slack = 1e-9 * self.sum2 + 0.5
        self.below: dict[int, tuple] = {}
        self.exact: dict[int, np.ndarray] = {}

    def bounds(self, nodes: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product below each of some nodes."""
        d = np.sqrt(np.maximum(0, self.sum2 - 2 * (self.tree.centres[nodes] @ self.q)))
        r = self.tree.radius[nodes]
        return (self.sum2 - (d + r) ** 2) / 2 - self.slack, (self.sum2 - np.maximum(0, d - r) ** 2) / 2 + self.slack

    def scores(self, node: int) -> np.ndarray:
        if node not in self.exact:
            a = self.tree.lo[node]
            b = a + self.tree.own[node]
            self.exact[node] = (np.rint(self.tree.values[a:b] @ self.q).astype(np.int64) if self.small
                                else self.tree.points[a:b].astype(np.int64) @ self.ints)
        return self.exact[node]

    def best(self, few: int, allowed: np.ndarray, ids: np.ndarray, least: int | None = None, most: int | None = None) -> list:
        """The first ``few`` (-score, id, point) of the allowed points with least <= score <= most."""
        tree, found = self.tree, []
        low, high = -math.inf if least is None else least, math.inf if most is None else most
        heap = [(-math.inf, 0)] if len(tree.centre) else []
        while heap:
            top, node = heapq.heappop(heap)
            if len(found) == few and -top < -found[-1][0]:
                break
            if tree.own[node]:
                a = tree.lo[node]
                s = self.scores(node)
                ok = allowed[a:a + len(s)] & (s >= low) & (s <= high)
                if len(found) == few:
                    ok &= s >= -found[-1][0]
                at = np.flatnonzero(ok)
                if len(at):
                    if len(at) > few:
                        at = at[np.lexsort((ids[a + at], -s[at]))[:few]]
                    found = sorted(found + [(-int(s[i]), int(ids[a + i]), int(a + i)) for i in at])[:few]
            if tree.children[node]:
                c = int(tree.child[node])
                if node not in self.below:
                    self.below[node] = self.bounds(slice(c, c + int(tree.children[node])))
                lb, ub = self.below[node]
                for k in np.flatnonzero((ub >= low) & (lb <= high)):
                    heapq.heappush(heap, (-min(float(ub[k]), high), c + int(k)))
        return found


# ---- Spark ------------------------------------------------------------------------------------------
def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, id, label, v): rows that take part, components as floor(256 * x)."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (rows.where(F.col(label_col).isNotNull() & x.isNotNull() & finite)
            .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                    F.col(label_col).cast("long").alias("label"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("long")).alias("v")))


def _matrix(column) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones padded by 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


_TREE = ("cell long, points binary, width int, longest2 double, rows binary, ids binary, labels binary, "
         + ", ".join(f"{f} binary" for f in CoverTree.FIELDS))


def build_trees(rows: DataFrame, blocks: int, groups: int) -> DataFrame:
    """One row a block of about BLOCK rows; ``cell`` is the group of trees searched together."""

    def build(key, table):
        ids = table["id"].fill_null(NO_ID).to_numpy()
        # a fixed order, however the rows came in
        start = np.lexsort((table["row"].to_numpy(), ids))
        tree, order = CoverTree.build(_matrix(table["v"])[start])
        order = start[order]
        blob = lambda a, t: [np.ascontiguousarray(a, t).tobytes()]
        columns = {"cell": [key[0].as_py() % groups], "points": blob(tree.points, np.int64), "width": [tree.points.shape[1]],
                   "longest2": [tree.longest2], "rows": blob(table["row"].to_numpy()[order], np.int64),
                   "ids": blob(ids[order], np.int64), "labels": blob(table["label"].to_numpy()[order], np.int64)}
        columns |= {f: blob(getattr(tree, f), np.float64 if f == "radius" else np.int64) for f in CoverTree.FIELDS}
        return pa.table(columns).cast(pa.schema([pa.field("cell", pa.int64()), pa.field("points", pa.binary()),
                                                 pa.field("width", pa.int32()), pa.field("longest2", pa.float64()),
                                                 *[pa.field(c, pa.binary()) for c in list(columns)[4:]]]))

    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    return written(rows.withColumn("block", block).groupBy("block").applyInArrow(build, _TREE), "cover-trees")


def _trees(table):
    for t in table.to_pylist():
        ints = lambda c: np.frombuffer(t[c], np.int64)
        nodes = {f: np.frombuffer(t[f], np.float64) if f == "radius" else ints(f) for f in CoverTree.FIELDS}
        points = ints("points").reshape(len(ints("ids")), t["width"])
        yield CoverTree(points, nodes, t["longest2"]), ints("rows"), ints("ids"), ints("labels")


def _cells(trees: DataFrame, anchors: DataFrame, groups: int, shares: int, work, schema: str) -> DataFrame:
    """``work`` on each pair of a group of trees and a share of the anchors."""
    cell = F.col("cell") * shares + F.col("share")
    left = trees.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("at", cell)
    right = (anchors.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(shares)))
             .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("at", cell))
    return left.groupBy("at").cogroup(right.groupBy("at")).applyInArrow(work, schema)


def _first(found: DataFrame, keys: list[str], few: int, name: str) -> DataFrame:
    order = "score DESC, found_id ASC NULLS LAST, found_row"
    rank = F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order})")
    return found.withColumn(name, rank).where(F.col(name) <= few)


def _found_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema.names]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _longs(*names: str) -> pa.Schema:
    return pa.schema([pa.field(n, pa.int64()) for n in names])


def mine(rows: DataFrame, anchor, few: int = 5, low: int = 80) -> DataFrame:
    """``rows`` (row, id, label, v); ``anchor``: a condition on ``id``. For each anchor its first ``few``
    other rows of its label, and for each of those the first ``few`` rows of other labels whose score
    is between ``low`` and 100 hundredths of the positive's."""
    rows = written(rows, "vectors")
    anchors = rows.where(anchor)
    n, asked = rows.count(), anchors.count()
    blocks = max(1, -(-n // BLOCK))
    groups = max(1, blocks // max(1, min(MOST_TREES, blocks // 64)))
    shares = max(1, -(-asked // ANCHORS))
    trees = build_trees(rows, blocks, groups)

    near = _longs("anchor_row", "anchor_id", "found_row", "found_id", "score")

    def positives(left, right):
        out = []
        asked = list(zip(right["row"].to_pylist(), right["id"].to_pylist(), right["label"].to_pylist(), _matrix(right["v"])))
        for tree, own, ids, labels in _trees(left):
            same = {x: labels == x for x in {a[2] for a in asked}}
            for row, name, label, q in asked:
                allowed = same[label] & (own != row)
                if allowed.any():
                    out += [(row, name, int(own[i]), None if d == NO_ID else d, -s)
                            for s, d, i in Search(tree, q).best(few, allowed, ids)]
        return _found_table(out, near)

    best = _first(_cells(trees, anchors, groups, shares, positives, ", ".join(f"{f.name} long" for f in near)),
                  ["anchor_row"], few, "place")
    windows = (best.groupBy(F.col("anchor_row").alias("row"))
               .agg(F.collect_list(F.struct("place", F.col("found_id").alias("positive_id"), "score")).alias("wins")))
    asking = written(anchors.join(windows, "row"), "anchors")

    hard = _longs("anchor_row", "anchor_id", "place", "positive_id", "positive_score", "found_row", "found_id", "score")

    def negatives(left, right):
        out = []
        asked = list(zip(right["row"].to_pylist(), right["id"].to_pylist(), right["label"].to_pylist(), _matrix(right["v"]),
                         right["wins"].to_pylist()))
        for tree, own, ids, labels in _trees(left):
            other = {x: labels != x for x in {a[2] for a in asked}}
            for row, name, label, q, wins in asked:
                search, known = Search(tree, q), {}
                for w in wins:
                    p = w["score"]
                    if p not in known:
                        known[p] = search.best(few, other[label], ids, -(-low * p // 100), p) if low * p <= 100 * p else []
                    out += [(row, name, w["place"], w["positive_id"], p, int(own[i]), None if d == NO_ID else d, -s)
                            for s, d, i in known[p]]
        return _found_table(out, hard)

    ranked = _first(_cells(trees, asking, groups, shares, negatives, ", ".join(f"{f.name} long" for f in hard)),
                    ["anchor_row", "place"], few, "rank")
    return ranked.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score",
                         F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    noisy = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", noisy), F.col("id") % 100 == 0)

"""Self-join of documents on the Jaccard similarity of their word shingles, by a MinHash LSH forest.

Each text is its set of 5-word shingles (a shorter text: one shingle of all its words). Texts with
equal sets are one *node*. A node's signature is cut into TREES label sequences, each a path in a
prefix tree of depth DEPTH. Nodes that share a tree's prefix are candidates: the prefix starts at
full depth and is shortened until the expected recall 1 - (1 - s**depth)**TREES at the similarity
threshold s reaches the target, so the depth follows from threshold and target alone.

Nobody emits the pairs of a prefix group: its nodes hang on the group's least node, and the groups
connect to candidate components. A component holds every candidate pair of its nodes, so the texts
travel once to their component, where all pairs are verified exactly in numpy and only counts and
local roots come out. Large components are cut into blocks, and every pair of blocks is one task.

Result, one row per input row: doc_id, class_id (least doc_id connected by similar pairs), n_links
(other rows at or above the threshold, copies included), n_texts (other shingle sets among them).

Defined cases: null and empty texts have no shingles, link to nothing and are classes of their own;
a null id counts as larger than all others and shows up as null; rows that repeat an id with
different texts are compared as different rows; repeated rows are copies of each other; an empty
table gives no rows; other input columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import NO_ID, chunks, mix, numbered, read, texts_of, word_grams, words_of, written
from kestrel.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 10
TARGET_RECALL = 0.98
BLOCK = 256              # nodes verified against each other in one task
CHUNK = 1 << 18

_SEEDS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def prefix_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The longest prefix whose expected recall at the threshold still reaches the target."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < target:
        depth -= 1
    return depth


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, behind each other, and where each text's begin."""
    words, first, *_ = words_of(texts)
    grams, begin = word_grams(words, first, SHINGLE)
    text = np.repeat(np.arange(len(texts)), np.diff(begin))
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    fresh = np.append(True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])) if len(grams) else np.zeros(0, bool)
    grams, text = grams[fresh], text[fresh]
    return grams, np.searchsorted(text, np.arange(len(texts) + 1))


def node_ids(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 63-bit hash of each non-empty set."""
    place = np.arange(len(grams)) - np.repeat(begin[:-1], np.diff(begin))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ mix(place.astype(np.uint64) + np.uint64(7))))])
    return (mix(total[begin[1:]] - total[begin[:-1]]) >> np.uint64(1)).astype(np.int64)


def tree_keys(grams: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
    """For each non-empty set, a key of the depth-long prefix in each tree (sets x TREES)."""
    keys = np.zeros((len(begin) - 1, TREES), np.uint64)
    for t in range(TREES):
        for level in range(depth):
            least = np.minimum.reduceat((grams * _SEEDS[t * DEPTH + level]) >> np.uint64(32), begin[:-1])
            keys[:, t] = mix(keys[:, t] * np.uint64(31) + least + np.uint64(t + 1))
    return keys.astype(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, node, keys): node and keys null for texts without words."""
    depth = prefix_depth()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, tags = texts_of(batch, "_text"), batch.column("_doc"), batch.column("_tag")
            for a, b in chunks([len(t) for t in texts], CHUNK):
                grams, begin = shingle_sets(texts[a:b])
                some = np.flatnonzero(np.diff(begin))
                cut = np.append(begin[some], len(grams))
                node, keys = np.zeros(b - a, np.int64), np.zeros((b - a, TREES), np.int64)
                if len(some):
                    node[some], keys[some] = node_ids(grams, cut), tree_keys(grams, cut, depth)
                none = np.ones(b - a, bool)
                none[some] = False
                flat = pa.array(keys.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * TREES), flat)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), tags.slice(a, b - a),
                                                  pa.array(node, mask=none), lists], ["doc", "tag", "node", "keys"])

    return (docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_doc"),
                        F.xxhash64(F.col(text_col).cast("string")).alias("_tag"),
                        F.col(text_col).cast("string").alias("_text"))
            .mapInArrow(sign, "doc long, tag long, node long, keys array<long>"))


def verify(texts: list[bytes], nodes: np.ndarray, weight: np.ndarray, part: np.ndarray, threshold: float):
    """All pairs among these nodes (with two parts: across them only) by exact Jaccard. Returns, per
    node, linked rows, linked texts and the least node it connects to."""
    grams, begin = shingle_sets(texts)
    size, n = np.diff(begin), len(texts)
    owner = np.repeat(np.arange(n), size)
    value, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count > 1
    new = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], new[column[keep]]
    common = np.zeros((n, n), np.float32)
    width = 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        common += m @ m.T
    union = size[:, None] + size[None, :] - common
    linked = common >= threshold * union - 1e-6
    np.fill_diagonal(linked, False)
    if len(np.unique(part)) > 1:
        linked &= part[:, None] != part[None, :]
    root = np.arange(n)
    while True:   # least reachable index
        least = np.where(linked, root[None, :], n).min(axis=1)
        new_root = np.minimum(root, least)
        new_root = new_root[new_root]
        if (new_root == root).all():
            break
        root = new_root
    return linked @ weight, linked.sum(axis=1), nodes[root]


def classes_of(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc, tag, class, n_links, n_texts) of every row; tag is a hash of its text."""
    signed = written(signatures(docs, id_col, text_col), "op4-signed")
    nodes = written(signed.where("node is not null").groupBy("node")
                    .agg(F.count(F.lit(1)).alias("weight"), F.min("doc").alias("doc"),
                         F.first("keys").alias("keys")), "op4-nodes")
    # forest nodes: equal prefixes meet; each member hangs on the least one
    paths = nodes.select("node", F.explode("keys").alias("path"))
    least = paths.groupBy("path").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = (paths.join(least, "path").where("node <> least")
             .select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    comps = components(edges, "op4-candidates")
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = (comps.join(sizes, "comp").join(nodes.select(F.col("node").alias("v"), "weight", "doc"), "v")
               .select("comp", F.col("v").alias("node"), "weight", "doc", blocks.alias("blocks"))
               .withColumn("own", own))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                        F.col(text_col).cast("string").alias("text"))
    placed = (texts.join(members, "doc")
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("comp", "node", "weight", "own", F.least("own", "other").alias("i"),
                      F.greatest("own", "other").alias("j"), "text"))

    def meet(t: pa.Table) -> pa.Table:
        raw, node = texts_of(t, "text"), t.column("node").to_numpy()
        # an id can belong to several texts: a node's text is the one that hashes to it, once
        grams, begin = shingle_sets(raw)
        some = np.diff(begin) > 0
        right = np.zeros(len(raw), bool)
        if some.any():
            right[some] = node_ids(grams, np.append(begin[:-1][some], len(grams))) == node[some]
        pick = np.flatnonzero(right)
        pick = pick[np.unique(node[pick], return_index=True)[1]]
        part, i, j = t.column("own").to_numpy()[pick], t.column("i")[0].as_py(), t.column("j")[0].as_py()
        rows, sets, root = verify([raw[p] for p in pick], node[pick], t.column("weight").to_numpy()[pick],
                                  part if i != j else np.zeros(len(pick), int), threshold)
        return pa.table([pa.array(node[pick]), pa.array(rows.astype(np.int64)), pa.array(sets.astype(np.int64)),
                         pa.array(root)], names=["node", "links", "texts", "root"])

    checked = written(placed.groupBy("comp", "i", "j")
                      .applyInArrow(meet, "node long, links long, texts long, root long")
                      .groupBy("node", "root").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts")),
                      "op4-checked")
    joined = components(checked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")),
                        "op4-classes")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    grouped = (nodes.select("node", "weight", "doc").join(links, "node", "left")
               .join(joined.select(F.col("v").alias("node"), "comp"), "node", "left")
               .withColumn("comp", F.coalesce("comp", "node")))
    least_doc = grouped.groupBy("comp").agg(F.min("doc").alias("class"))
    grouped = grouped.join(least_doc, "comp").select("node", "weight", "links", "texts", "class")
    return (signed.select("doc", "tag", "node").join(grouped, "node", "left")
            .select("doc", "tag", F.coalesce("class", "doc").alias("class"),
                    (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links"),
                    F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts")))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row; see the module's text."""
    shown = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return classes_of(docs, threshold, id_col, text_col).select(
        shown("doc").alias("doc_id"), shown("class").alias("class_id"), "n_links", "n_texts")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the least id stays, of repeated rows one.
    Documents without words are classes of their own; of near copies without ids all stay. All
    columns of the documents stay, whatever their names."""
    plain, names = numbered(docs, ("doc_id", "text"))
    gone = classes_of(plain).where("doc <> class").select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).distinct()
    rows = plain.withColumn("_doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("_tag", F.xxhash64("text"))
    kept = rows.join(gone, ["_doc", "_tag"], "left_anti").dropDuplicates(["_doc", "_tag"])
    return kept.select(*names).toDF(*docs.columns)

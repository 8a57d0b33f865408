"""Quality by compression: texts like good ones compress better with a dictionary of good texts.

From at most PER_CLASS labelled texts of each class (a fixed bound) outside the test fold, one
zstandard dictionary is built per class and view; the views are the text itself and its shape
(letters, capitals and digits each written as one character, which carries over to other words and
languages). A text is compressed in consecutive pieces of PIECE bytes, so that the dictionaries tell
on all of it and not only before zstandard has met enough of the text itself. A text's evidence per
view is the difference of its compressed sizes, summed over its pieces, with the two dictionaries and
its size without one, all divided by its length. The dictionaries see two thirds of the sample, of a
text longer than MOST_BYTES that many in pieces spread over it; on the other third, texts of any
length taken whole, a logistic regression turns the evidence into the probability of label 1, which
is the score.

Defined cases: null and empty texts have no evidence and get the share of label 1 among empty texts
as the regression sees it; rows without an id are scored and never learned from; repeated rows score
alike; an empty table gives no rows; with fewer than two classes of labels every score is 0.5; an
input column named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import in_test_fold, labelled_sample, read, texts_of, under_plain_names
from kestrel.llm.toxicity import rows_schema

PER_CLASS = 2000
MOST_BYTES = 1 << 16
PIECE = 2048
DICTIONARY = 48 << 10
LEVEL = 3
LIMIT = 0.7

_SHAPE = bytes(ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57
               else b for b in range(256))


def views(text: bytes) -> tuple[bytes, bytes]:
    return text, text.translate(_SHAPE)


def pieces_of(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def spread(text: bytes) -> bytes:
    """At most MOST_BYTES of a text, in pieces at even distances from its first to its last one."""
    if len(text) <= MOST_BYTES:
        return text
    return b"".join(text[i : i + PIECE] for i in np.linspace(0, len(text) - PIECE, MOST_BYTES // PIECE).astype(int))


class Scorer:
    """Two dictionaries per view and the regression's weights."""

    def __init__(self, good: list[bytes], bad: list[bytes]):
        self.raw = []
        for v in range(2):
            pair = []
            for side in (good, bad):
                texts = [views(t)[v] for t in side]
                # a small sample still makes a dictionary: its texts cut into more samples
                pieces = [t[i : i + 2000] for t in texts for i in range(0, len(t), 2000)]
                try:
                    pair.append(zstandard.train_dictionary(DICTIONARY, pieces, k=200, d=8).as_bytes())
                except zstandard.ZstdError:
                    pair.append(b"".join(pieces)[-DICTIONARY:])
            self.raw.append(pair)
        self.weights = self.mean = self.scale = None
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None, "_plain": None}

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        if self._tools is None:
            tool = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False)
            self._tools = [[tool(d) for d in pair] for pair in self.raw]
            self._plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        out = np.zeros((len(texts), 5))
        for i, t in enumerate(texts):
            n = len(t)
            if not n:
                continue
            for v, view in enumerate(views(t)):
                pieces = pieces_of(view)
                good, bad, plain = (sum(len(c.compress(p)) for p in pieces) for c in (*self._tools[v], self._plain))
                out[i, 2 * v] = (bad - good) / n
                out[i, 2 * v + 1] = plain / n
            out[i, 4] = np.log(n)
        return out

    def inputs(self, e: np.ndarray) -> np.ndarray:
        x = (e - self.mean) / self.scale
        x = np.clip(x, -8, 8)
        pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
        return np.column_stack([np.ones(len(x)), x, *pairs])

    def fit(self, e: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps."""
        self.mean, self.scale = e.mean(axis=0), e.std(axis=0) + 1e-6
        x = self.inputs(e)
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
            w += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.3 * w)
        self.weights = w

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = self.inputs(self.evidence(texts)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: DataFrame) -> Scorer | None:
    """From rows (doc_id, t, _y) of bounded number; None if they lack one of the classes."""
    spark = rows.sparkSession

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = pa.array([spread(t) for t in texts_of(batch, "t")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), short, batch.column("_y")],
                                             ["doc_id", "tag", "t", "_y"])

    tagged = rows.select("doc_id", F.xxhash64("t").alias("tag"), "t", F.col("_y").cast("int").alias("_y"))
    got = tagged.mapInArrow(heads, "doc_id long, tag long, t binary, _y int").toArrow()
    sample = sorted(zip(*[got[c].to_pylist() for c in ("doc_id", "t", "_y", "tag")]))
    y = np.array([v for _, _, v, _ in sample], float)
    if len(y) < 6 or y.min() == y.max():
        return None
    held = np.arange(len(y)) % 3 == 2
    scorer = Scorer(*[[t for (_, t, v, _), h in zip(sample, held) if v == side and not h] for side in (1, 0)])
    if y[held].min() == y[held].max():
        held[:] = True
    asked = {(d, tag) for (d, _, _, tag), h in zip(sample, held) if h}
    shared = spark.sparkContext.broadcast((scorer, asked))      # four dictionaries and PER_CLASS keys

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, asked = shared.value
        for batch in batches:
            keys = list(zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist()))
            some = [(k, t) for k, t in zip(keys, texts_of(batch, "t")) if k in asked]
            e = scorer.evidence([t for _, t in some])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in some], pa.int64()), pa.array([k[1] for k, _ in some], pa.int64()),
                 pa.array(list(e), pa.list_(pa.float64()))], ["doc_id", "tag", "e"])

    got = tagged.mapInArrow(weigh, "doc_id long, tag long, e array<double>").toArrow()
    found = dict(zip(zip(got["doc_id"].to_pylist(), got["tag"].to_pylist()), got["e"].to_pylist()))
    e = np.array([found[d, tag] for (d, _, _, tag), h in zip(sample, held) if h])
    scorer.fit(e, y[held], np.ones(len(e)))
    return scorer


def scored(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score (double)."""
    return under_plain_names(docs, ("doc_id", text_col), lambda plain: _scored(plain, labels, text_col))


def _scored(docs: DataFrame, labels: DataFrame, text_col: str) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(      # four dictionaries and a few weights
        train(labelled_sample(docs, labels, "quality", PER_CLASS)))
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "quality_score"])
    columns = base.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, text_col)
            s = model.value.score(texts) if model.value is not None and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(s, pa.float64())],
                                             [*columns, "quality_score"])

    return base.mapInArrow(score, f"{rows_schema(base)}, quality_score double")


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", in_test_fold().alias("held_out"), F.col("quality_score").alias("score"),
                      (F.col("quality_score") >= LIMIT).cast("int").alias("predicted"))

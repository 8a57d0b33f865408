"""Toxicity by a convolutional text classifier, trained and run in numpy.

A text's plain tokens and their first bytes are hashed to BUCKETS embedding rows, which add up to a
word's embedding (so that inflected and unseen forms share rows); filters of several widths run over them,
the maximum of each filter over the whole text is kept, and a linear layer turns the maxima into a
logit. One embedding dimension starts from the logarithm of how many standard deviations a bucket's
count in toxic texts lies off its expectation (0 if it may be chance), so that the pooled maxima
point at telling words from the first step; then everything is trained with Adam.

Learning uses every labelled document outside the test fold, whole; a quarter of them, by a hash of the id,
is held back to calibrate. They are written once, dealt by id into files of about BLOCK documents. In each
of EPOCHS passes every task starts from the same network and trains on its rows; the networks are averaged
by rows, an embedding row over the tasks that used it. Bucket counts and calibration counts are
sums over all rows. The driver holds one network and the counts of logits by 1/BINS, never a text. The language is
told from the text by counts of function words, never from a column. Each language gets the threshold with the
best F1 on its calibration texts (with all others' as a prior), and its logits are shifted so that the
threshold lies at a score of 0.3 everywhere.

Defined cases: null and empty texts score like a text of padding; rows without an id are scored and
never learned from; repeated rows score alike; an empty table gives no rows; with fewer than two
classes of labels every score is 0; input columns named like results are replaced in ``classify``.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import chunks, in_test_fold, numbered, read, texts_of, tokens_of, under_plain_names, written

BUCKETS = 1 << 17
PREFIXES = (4, 5, 6, 7, 8)   # bytes
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 12
BLOCK = 8192                 # documents a file of the training set
STEP = 64                    # texts a step of Adam
STEP_BYTES = 1 << 22         # and no more than this
MIXED = 2048                 # texts that are put in random order at once
SLICE = 1 << 14              # entries of a sum that one group adds up
BINS, FAR = 256, 64          # calibration counts logits by 1 / BINS, up to FAR
EPOCHS = 4
LIMIT = 0.3
CHUNK = 1 << 18
PAD = max(WIDTHS)

FUNCTION_WORDS = {
    "en": "the of and to is that for with was it",
    "fr": "le les des et un une dans pour que est",
    "de": "der die und das ist zu den mit von ein",
    "es": "el los las y en por con del una como",
}


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket ids (places x (1 + prefixes)) with PAD rows of zeros after each text, where each text
    begins, and its language number."""
    words, first = tokens_of(texts, PREFIXES)
    n = np.diff(first)
    begin = np.concatenate([[0], np.cumsum(n + PAD)])
    ids = np.zeros((begin[-1], 1 + len(PREFIXES)), np.int32)
    text = np.repeat(np.arange(len(texts)), n)
    ids[np.arange(len(words)) + text * PAD] = np.where(words, words % np.uint64(BUCKETS - 1) + np.uint64(1), 0)
    votes = np.zeros((len(texts), len(FUNCTION_WORDS)))
    for k, listed in enumerate(FUNCTION_WORDS.values()):
        known = np.sort(tokens_of([listed.encode()])[0])
        hit = known[np.minimum(np.searchsorted(known, words[:, 0]), len(known) - 1)] == words[:, 0]
        votes[:, k] = np.bincount(text[hit], minlength=len(texts))
    return ids, begin, np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(FUNCTION_WORDS))


class Net:
    def __init__(self, seed: int = 8):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = r.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32)
            self.p[f"W{w}"][0, : FILTERS // 2] = 1.0     # half of the filters start on the log-odds
            self.p[f"c{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.p["b"] = np.zeros(1, np.float32)
        self.shift = np.zeros(len(FUNCTION_WORDS) + 1)
        self.slope = 1.0

    def embed(self, ids: np.ndarray) -> np.ndarray:
        x = self.p["E"][ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.p["E"][ids[:, k]]
        return x

    def pooled(self, ids: np.ndarray, begin: np.ndarray, where: bool = False):
        """Maxima of all filters for each text (and the windows they come from)."""
        x, maxima, places = self.embed(ids), [], []
        for w in WIDTHS:
            n = len(ids) - w + 1
            win = np.concatenate([x[i : i + n] for i in range(w)], axis=1) if w > 1 else x
            a = win @ self.p[f"W{w}"] + self.p[f"c{w}"]
            at = begin[:-1]
            for back in range(1, w):      # windows stay inside their text
                a[begin[1:-1] - back] = -1e9
            m = np.maximum.reduceat(a, at, axis=0)
            maxima.append(m)
            if where:
                own = np.repeat(np.arange(len(at)), np.diff(np.append(at, n)))
                place = np.full(m.shape, -1, np.int64)
                rows, cols = np.nonzero(a == m[own])
                place[own[rows], cols] = rows
                places.append(place)
        return np.concatenate(maxima, axis=1), places

    def logits(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        m, _ = self.pooled(ids, begin)
        return np.maximum(m, 0) @ self.p["out"] + self.p["b"][0]

    def gradients(self, ids, begin, y):
        m, places = self.pooled(ids, begin, where=True)
        h = np.maximum(m, 0)
        z = h @ self.p["out"] + self.p["b"][0]
        d = (1 / (1 + np.exp(-z)) - y).astype(np.float32) / len(y)
        g = {"out": h.T @ d, "b": np.array([d.sum()], np.float32)}
        dh = d[:, None] * self.p["out"][None, :] * (m > 0)
        ge = {}
        for k, w in enumerate(WIDTHS):
            dw, place = dh[:, k * FILTERS : (k + 1) * FILTERS], places[k]
            win = ids[place[:, :, None] + np.arange(w)]                       # texts, filters, width, parts
            x = self.p["E"][win].sum(axis=3).reshape(*place.shape, w * DIM)
            g[f"W{w}"] = np.einsum("tf,tfd->df", dw, x)
            g[f"c{w}"] = dw.sum(axis=0)
            ge[w] = (win, dw[:, :, None, None] * self.p[f"W{w}"].T.reshape(1, FILTERS, w, DIM))
        return g, ge

    def start(self, bad: np.ndarray, good: np.ndarray, toxic: float, n: float) -> None:
        """The first embedding dimension from the numbers of texts that hold a bucket, by class."""
        expected = (bad + good) * (toxic / n)
        z = (bad - expected) / np.sqrt(expected * (1 - toxic / n) + 1)
        self.p["E"][:, 0] = np.where(np.abs(z) > 3.5, np.sign(z) * np.log1p(np.abs(z)), 0)
        self.p["E"][0] = 0

    def learn(self, runs: Iterator[tuple[list[bytes], np.ndarray]], seed: int) -> tuple[np.ndarray, int]:
        """A pass of Adam over (texts, labels); the buckets used and the number of texts."""
        r, t, n = np.random.default_rng(seed), 0, 0
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        used = np.zeros(BUCKETS, bool)
        for texts, y in runs:
            order = r.permutation(len(y))
            for lo, hi in chunks([max(len(texts[i]), STEP_BYTES // STEP) for i in order], STEP_BYTES):
                pick = order[lo:hi]
                ids, begin, _ = padded([texts[i] for i in pick])
                g, ge = self.gradients(ids, begin, y[pick])
                t, n = t + 1, n + len(pick)
                for k, v in g.items():
                    self.step(k, slice(None), v, moments, t)
                touched = np.concatenate([w.ravel() for w, _ in ge.values()])
                values = np.concatenate([np.repeat(v.reshape(-1, DIM), ids.shape[1], axis=0) for _, v in ge.values()])
                uniq, inv = np.unique(touched, return_inverse=True)
                grad = np.zeros((len(uniq), DIM), np.float32)
                np.add.at(grad, inv, values)
                self.step("E", uniq, grad, moments, t, 0.0005)
                self.p["E"][0] = 0
                used[uniq] = True
        return used, n

    def step(self, k, rows, grad, moments, t, rate=0.01):
        m, v = moments[k]
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        self.p[k][rows] -= rate * (m[rows] / (1 - 0.9**t)) / (np.sqrt(v[rows] / (1 - 0.99**t)) + 1e-6)

    def calibrate(self, z: np.ndarray, y: np.ndarray, lang: np.ndarray, n: np.ndarray) -> None:
        """A slope for all, and for each language the logit threshold of the best weighted F1, from counts
        ``n`` of texts with logits from z / BINS to (z + 1) / BINS."""
        mid = (z + 0.5) / BINS
        mean = np.average(mid, weights=n)
        self.slope = float(np.clip(4.0 / (np.sqrt(np.average((mid - mean) ** 2, weights=n)) + 1e-6), 0.05, 5.0))
        bins, at = np.unique(-z, return_inverse=True)      # from the highest
        for k in range(len(self.shift)):
            weight = n * np.where(lang == k, 1.0, 0.3)
            all_, toxic = np.bincount(at, weight), np.bincount(at, weight * y)
            best = int((2 * np.cumsum(toxic) / (np.cumsum(all_) + toxic.sum())).argmax())
            low = -bins[best]
            high = -bins[best + 1] + 1 if best + 1 < len(bins) else low - BINS
            self.shift[k] = (low + high) / 2 / BINS

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, begin, lang = padded(texts)
        z = self.slope * (self.logits(ids, begin) - self.shift[lang]) + np.log(LIMIT / (1 - LIMIT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60))), lang


def training_set(docs: DataFrame, labels: DataFrame, text_col: str) -> DataFrame:
    """(t, y, held) of every labelled document outside the test fold, written once. Of the other texts
    only those that a bitmap of the labelled ids lets through (about one in 16) are shuffled."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~in_test_fold())
             .groupBy("doc_id").agg(F.max("toxic").alias("y")).where(F.col("y").isin(0, 1)))
    n = known.count()
    blocks, bits = max(1, -(-n // BLOCK)), min(1 << 27, max(1 << 15, 16 * n))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    marks = known.groupBy((spot / 32768).cast("long").alias("_b")).agg(     # at most 16 MB
        F.expr(f"bitmap_construct_agg(bitmap_bit_position(pmod(xxhash64(doc_id), {bits}) % 32768 + 1))").alias("_m"))
    rows = docs.select("doc_id", F.col(text_col).cast("string").cast("binary").alias("t")).where("t is not null")
    rows = rows.where(~in_test_fold()).withColumn("_b", (spot / 32768).cast("long")).join(F.broadcast(marks), "_b")
    place = (spot % 32768).cast("int")
    byte = F.conv(F.hex(F.substring("_m", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.where(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0)
    # by hash of the id: texts of all kinds in every block
    rows = rows.select("doc_id", "t").repartition(blocks, "doc_id").join(known.repartition(blocks, "doc_id"), "doc_id")
    order = F.xxhash64("doc_id", F.lit("train"))
    return written(rows.select("t", "y", (F.pmod(order, F.lit(4)) == 3).alias("held"), order.alias("_o"))
                   .sortWithinPartitions("_o", "t").select("t", "y", "held"), "toxicity-training")


def runs_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(texts, labels) of up to ``most`` rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            part = batch.slice(lo, most)
            yield texts_of(part, "t"), np.asarray(part["y"].to_numpy(zero_copy_only=False), np.float32)


def summed(rows: DataFrame, vector_of, size: int) -> np.ndarray:
    """The sum of one vector of ``size`` numbers a task, added up slice by slice in the order of the tasks."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = vector_of(batches)
        if v is not None:
            parts = [v[lo : lo + SLICE].astype(np.float32).tobytes() for lo in range(0, size, SLICE)]
            task_id = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task_id] * len(parts), pa.int32()),
                                              pa.array(parts, pa.binary())], ["slice", "task", "v"])

    def add(group: pa.Table) -> pa.Table:
        total = 0.0
        for v in group.sort_by("task")["v"]:
            total = total + np.frombuffer(v.as_buffer(), np.float32).astype(np.float64)
        return pa.table({"slice": group["slice"].slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    out = (rows.mapInArrow(task, "slice int, task int, v binary")
           .groupBy("slice").applyInArrow(add, "slice int, v binary").toArrow().sort_by("slice"))
    return np.concatenate([np.frombuffer(v.as_buffer(), np.float64) for v in out["v"]]) if out.num_rows else np.zeros(size)


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
    """Texts that hold a bucket, by class, and the number of toxic texts and of all."""
    counts, n = np.zeros((2, BUCKETS)), np.zeros(2)
    for texts, y in runs_of(batches, MIXED):
        for a, b in chunks([len(t) for t in texts], CHUNK):
            ids, begin, _ = padded(texts[a:b])
            text = np.repeat(np.arange(b - a), np.diff(begin))
            held = np.unique(text[:, None] * BUCKETS + ids)
            bad = y[a:b][held // BUCKETS] > 0
            for k, which in enumerate((bad, ~bad)):
                counts[k] += np.bincount(held[which] % BUCKETS, minlength=BUCKETS)
        n += y.sum(), len(y)
    return np.concatenate([counts.ravel(), n]) if n[1] else None


def logit_counts(net: Net, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, y in runs_of(batches, MIXED):
        rows = []
        for a, b in chunks([len(t) for t in texts], CHUNK):
            ids, begin, lang = padded(texts[a:b])
            z = np.floor(np.clip(net.logits(ids, begin), -FAR, FAR) * BINS)
            rows.append(np.stack([z, y[a:b], lang], axis=1).astype(np.int64))
        rows, n = np.unique(np.concatenate(rows), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in rows.T], pa.array(n, pa.int64())], ["z", "y", "lang", "n"])


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> Net | None:
    """The trained, calibrated net; None without eight labelled documents of both classes."""
    spark = docs.sparkSession
    rows = training_set(docs, labels, text_col)
    have = {(r["held"], r["y"]): r["count"] for r in rows.groupBy("held", "y").count().collect()}
    if sum(have.values()) < 8 or len({y for _, y in have}) < 2:
        return None
    apart = len(have) == 4       # both classes on both sides; else all rows fit and calibrate
    fit = (rows.where("not held") if apart else rows).select("t", "y")
    net = Net()
    counts = summed(fit, bucket_counts, 2 * BUCKETS + 2)
    net.start(counts[:BUCKETS], counts[BUCKETS : 2 * BUCKETS], *counts[-2:])
    small = [k for k in net.p if k != "E"]
    size = BUCKETS * (DIM + 1) + sum(net.p[k].size for k in small) + 1
    for epoch in range(EPOCHS):
        before = spark.sparkContext.broadcast(net)

        def moved(batches: Iterator[pa.RecordBatch], epoch: int = epoch, before=before) -> np.ndarray | None:
            own, base = copy.deepcopy(before.value), before.value
            used, n = own.learn(runs_of(batches, MIXED), 9 + epoch)
            if n:
                change = [(own.p["E"] - base.p["E"]).ravel() * n, used * float(n), *[(own.p[k] - base.p[k]).ravel() * n for k in small]]
                return np.concatenate([*change, [n]])

        total = summed(fit, moved, size)
        e, weight, rest = np.split(total[:-1], [BUCKETS * DIM, BUCKETS * (DIM + 1)])
        net = copy.deepcopy(net)
        net.p["E"] += (e.reshape(BUCKETS, DIM) / np.maximum(weight, 1)[:, None]).astype(np.float32)
        for k in small:
            step, rest = rest[: net.p[k].size], rest[net.p[k].size :]
            net.p[k] += (step.reshape(net.p[k].shape) / total[-1]).astype(np.float32)
        before.unpersist()
    model = spark.sparkContext.broadcast(net)
    seen = (rows.where("held") if apart else rows).select("t", "y")
    counts = (seen.mapInArrow(lambda batches: logit_counts(model.value, batches), "z long, y long, lang long, n long")
              .groupBy("z", "y", "lang").agg(F.sum("n").alias("n")).toArrow())
    net.calibrate(*[counts[c].to_numpy() for c in ("z", "y", "lang", "n")])
    return net


def rows_schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with toxic_score (double) and toxic_lang (the language told from the text)."""
    return under_plain_names(docs, ("doc_id", text_col), lambda plain: _classify(plain, labels, text_col))


def _classify(docs: DataFrame, labels: DataFrame, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    net = train(docs, labels, text_col)
    model = spark.sparkContext.broadcast(net)      # fixed size: BUCKETS x DIM floats and the filters
    names = [*FUNCTION_WORDS, "other"]
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("toxic_score", "toxic_lang")])

    columns = base.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, langs = texts_of(batch, text_col), [], []
            for a, b in chunks([len(t) for t in texts], CHUNK):
                if model.value is None:
                    s, lang = np.zeros(b - a), padded(texts[a:b])[2]
                else:
                    s, lang = model.value.scores(texts[a:b])
                out.append(s)
                langs += [names[k] for k in lang]
            cols = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(out) if out else np.zeros(0)),
                                              pa.array(langs, pa.string())], [*columns, "toxic_score", "toxic_lang"])

    return base.mapInArrow(score, f"{rows_schema(base)}, toxic_score double, toxic_lang string")


def op8_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", in_test_fold().alias("held_out"), F.col("toxic_score").alias("score"),
                      (F.col("toxic_score") >= LIMIT).cast("int").alias("predicted"), "toxic_lang")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored LIMIT or more go. All columns of the others stay, whatever
    their names."""
    plain, names = numbered(docs, ("doc_id", "text"))
    kept = classify(plain, read(spark, sf_dir, "labels")).where(F.col("toxic_score") < LIMIT)
    return kept.select(*names).toDF(*docs.columns)

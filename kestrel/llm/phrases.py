"""Phrase (collocation) mining by mergeable Misra-Gries summaries.

A phrase is a run of 1 to LONGEST words of one piece of a text. Every phrase with at least
``threshold`` occurrences in its language is to be found, without a table of all phrases:

1. Each task hashes the phrases of its texts, counts equal ones of a batch, and deals the counts to
   hash partitions (leading bits of the phrase's hash; the next 32 bits are its key there). One
   Misra-Gries summary per hash partition merges what arrives: it keeps more counters than
   CAPACITY x mass / threshold and lowers all of them when it overflows. A counter is too low by
   less than threshold / CAPACITY, so no frequent phrase is lost, however the rows are dealt. Two
   phrases of one key share a counter, which only lets more through.
2. Survivors are bits of a fixed-size filter per hash partition. Words and pairs go first; of longer
   runs only those enter the second round whose pairs all survived (a frequent run's pairs are
   frequent), so the long tail never crosses the network.
3. A last pass counts the phrases that pass the filters exactly, by their words.

The phrases of a batch are told apart by 64-bit hashes, those of different batches by their words.
The filters are the only broadcast: at most MOST_FILTER bytes; where more hash partitions share it,
it lets more phrases through to the exact count, which shuffles more and stays exact.

Defined cases: a null text is empty, a null language is ``und``; ids play no part, repeated rows
count again, other columns are ignored whatever their names; empty tables give no phrases. Long
texts are cut into segments of about CHUNK bytes between words, with the next words of the piece
behind them, so that each run is counted once, where it begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import joined, mix, prefix, range_hash, read, text_bytes, written

LONGEST = 5
CAPACITY = 4
CHUNK = 1 << 20
#: Text bytes a hash partition, filter bits a hash partition, and filter bytes in all.
SHARE, FILTER_BITS, MOST_FILTER = 32 << 20, 1 << 18, 256 << 20
MERGE_ROWS = 1 << 19

_WORD, _BLANK, _BREAK = range(3)
_KIND = np.zeros(256, np.int8)
_KIND[[32, 9]] = _BLANK
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = _BREAK
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_CUT = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_NEXT_WORDS = re.compile(rb"(?:[ \t]*[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}" % (LONGEST - 1))
_STEP = np.uint64(0x9FB21C651E98DF25)
_SECOND = np.uint64(0x85EBCA6B)
_LOW32 = np.uint64(0xFFFFFFFF)


# ---- words and runs of a batch --------------------------------------------------------------------
def segments(texts: Iterable[bytes], most: int):
    """(text number, bytes, own): the runs that begin in the first ``own`` bytes belong to the
    segment; what follows them are the next words of the same piece."""
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > most:
            found = _CUT.search(t, at + most)
            if not found:
                break
            cut = found.start()
            yield i, t[at:_NEXT_WORDS.match(t, cut).end()], cut - at
            at = cut
        yield i, t[at:], len(t) - at


def batches(texts: Iterable[bytes], langs: list[str], most: int = CHUNK):
    """Words of consecutive segments of about ``most`` bytes."""
    held, size = [], 0
    for s in segments(texts, most):
        if held and size + len(s[1]) > most:
            yield Runs(held, langs)
            held, size = [], 0
        held.append(s)
        size += len(s[1])
    if held:
        yield Runs(held, langs)


class Runs:
    """The words of some segments and the hashes of their runs."""

    def __init__(self, held: list, langs: list[str]):
        import xxhash

        buf, offs = joined([s[1] for s in held], b"\n")
        low, kind = _LOWER[buf], _KIND[buf]
        edge = np.diff(np.concatenate([[0], (kind == _WORD).view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        seg = np.searchsorted(offs, start, "right") - 1
        names = sorted({langs[s[0]] for s in held})
        number = {x: i for i, x in enumerate(names)}
        lang_of = np.array([number[langs[s[0]]] for s in held], np.int64)
        own = np.array([s[2] for s in held], np.int64)
        self.names, self.lang = names, lang_of[seg]
        self.own = start - offs[seg] < own[seg]
        self.piece = np.cumsum(kind == _BREAK, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
        self.words = range_hash(prefix(low.astype(np.uint64) + np.uint64(1)), start, end)
        self.seed = seeds[self.lang] if len(start) else np.zeros(0, np.uint64)
        self.low, self.start, self.end, self.inside = low, start, end, kind == _WORD

    def hashes(self):
        """For 1 to LONGEST words: (first word of each run, hash of the run)."""
        h, at = mix(self.words + self.seed), np.flatnonzero(self.own)
        yield at, h[at]
        for n in range(2, LONGEST + 1):
            last = len(self.words) - n + 1
            if last <= 0:
                return
            h = mix(h[:last] * _STEP + self.words[n - 1:])
            at = at[at < last]
            at = at[self.piece[at] == self.piece[at + n - 1]]
            yield at, h[at]

    def phrases(self, first: np.ndarray, n: int) -> pa.Array:
        """The runs of ``n`` words from ``first`` on, words joined by one space."""
        if not hasattr(self, "clean"):
            size = self.end - self.start
            self.clean = np.full(int(size.sum()) + len(size), 32, np.uint8)
            self.clean[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = self.low[self.inside]
            self.at = np.cumsum(size + 1) - size - 1
        a = self.at[first]
        size = self.at[first + n - 1] + self.end[first + n - 1] - self.start[first + n - 1] - a
        offs = np.concatenate([[0], np.cumsum(size)])
        flat = self.clean[np.repeat(a - offs[:-1], size) + np.arange(offs[-1])]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(flat))


def counted(hashes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and how often each is there."""
    if weights is None:
        h = np.sort(hashes)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.diff(np.append(first, len(h)))
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(weights[order], first) if len(h) else weights


# ---- filters ----------------------------------------------------------------------------------------
class Filter:
    """Survivors by hash: 2**bits places for each of 2**parts hash partitions, two places a survivor."""

    def __init__(self, parts: int, bits: int, places: np.ndarray):
        self.parts, self.bits, self.places = parts, bits, places

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        part, key = split(hashes, self.parts)
        base = part << np.uint64(self.bits)
        ok = np.ones(len(hashes), bool)
        for spot in spots(key, self.bits):
            at = base | spot
            ok &= (self.places[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def split(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes >> np.uint64(64 - parts), (hashes >> np.uint64(32 - parts)) & _LOW32


def spots(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    down = np.uint64(32 - bits)
    return key >> down, ((key * _SECOND) & _LOW32) >> down


# ---- Misra-Gries ------------------------------------------------------------------------------------
class Summary:
    """A Misra-Gries summary for ``mass`` occurrences: of the keys with ``threshold`` or more none is
    lost. Batches of counts are held back and merged together; merging other summaries' counters is
    the same step, with their ``lowered`` added."""

    def __init__(self, mass: int, threshold: int):
        self.threshold, self.capacity = threshold, CAPACITY * mass // threshold + 1
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.lowered, self.held, self.size = 0, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray, lowered: int = 0) -> None:
        self.held.append((keys, counts))
        self.lowered += lowered
        self.size += len(keys)
        if self.size > self.capacity + MERGE_ROWS:
            self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        keys, counts = counted(np.concatenate([self.keys, *[k for k, _ in self.held]]),
                               np.concatenate([self.counts, *[c for _, c in self.held]]))
        self.held, self.size = [], 0
        if len(keys) > self.capacity:
            cut = np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            self.lowered += int(cut)
            keys, counts = keys[counts > cut], counts[counts > cut] - cut
        self.keys, self.counts = keys, counts

    def survivors(self) -> np.ndarray:
        """Keys that may have reached the threshold."""
        self.merge()
        return self.keys[self.counts + self.lowered >= self.threshold]


_ROUND = "p long, late boolean, mass long, keys binary, counts binary"


def _runs_of(batch, most: int = CHUNK):
    texts = (t.as_py() or b"" for t in batch.column(0).cast(pa.binary()))
    return batches(texts, batch.column(1).to_pylist(), most)


def survivors(rows: DataFrame, parts: int, bits: int, threshold: int, pairs=None) -> Filter:
    """One round: words and pairs without ``pairs``, else (a broadcast filter) the longer runs."""

    def deal(batch_iter):
        for batch in batch_iter:
            for runs in _runs_of(batch):
                found = []
                for n, (at, h) in enumerate(runs.hashes(), 1):
                    if n > 2 and pairs is None:
                        break
                    if n == 2 and pairs is not None:
                        good = np.zeros(len(runs.words) + LONGEST, bool)
                        good[at] = pairs.value(h)
                        # the pairs of the last words belong to the next segment and are not judged here
                        good[:len(runs.words)] |= ~runs.own
                    if pairs is None:
                        found.append(h)
                    elif n > 2:
                        ok = good[at]
                        for k in range(1, n - 1):
                            ok &= good[at + k]
                        found.append(h[ok])
                if not found:
                    continue
                keys, counts = counted(np.concatenate(found))
                part, key = split(keys, parts)
                key = key.astype(np.uint32)
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
                spans = list(zip(first, [*first[1:], len(part)]))
                p = [int(part[a]) for a, _ in spans]
                none = [None] * len(p)
                mass = [int(counts[a:b].sum()) for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p * 2, pa.int64()), pa.array([False] * len(p) + [True] * len(p)), pa.array(mass * 2, pa.int64()),
                     pa.array(none + [key[a:b].tobytes() for a, b in spans], pa.binary()),
                     pa.array(none + [counts[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary())],
                    names=["p", "late", "mass", "keys", "counts"])

    def finish(p: int, summary: Summary):
        places = np.zeros((1 << bits) // 8, np.uint8)
        keys = summary.survivors().astype(np.uint64)
        for spot in spots(keys, bits):
            np.bitwise_or.at(places, (spot >> np.uint64(3)).astype(np.int64),
                             np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8))
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([places.tobytes()], pa.binary())],
                                          names=["p", "places"])

    def summarise(batch_iter):
        # sorted by partition, the masses of a partition before its counts
        now, mass, summary = None, 0, None
        for batch in batch_iter:
            for p, late, m, keys, counts in zip(*[c.to_pylist() for c in batch.columns]):
                if p != now:
                    if summary is not None:
                        yield finish(now, summary)
                    now, mass, summary = p, 0, None
                if not late:
                    mass += m
                    continue
                summary = summary or Summary(mass, threshold)
                summary.add(np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.uint32).astype(np.int64))
        if summary is not None:
            yield finish(now, summary)

    dealt = rows.mapInArrow(deal, _ROUND).repartition(1 << parts, "p").sortWithinPartitions("p", "late")
    places = np.zeros(1 << (parts + bits - 3), np.uint8)
    step = (1 << bits) // 8
    for r in dealt.mapInArrow(summarise, "p long, places binary").toLocalIterator():  # MOST_FILTER bytes in all
        places[r["p"] * step:(r["p"] + 1) * step] = np.frombuffer(r["places"], np.uint8)
    return Filter(parts, bits, places)


def exact_counts(rows: DataFrame, short: "Filter", long: "Filter", parts: int, threshold: int) -> DataFrame:
    """(lang, words, phrase, f) of the phrases that pass the (broadcast) filters and reach the threshold;
    under the empty phrase of 0 words, all words of the language. A batch's counts go to the phrases'
    hash partitions as lists, and each partition adds them up by phrase and language."""

    def counts_of(runs) -> pa.Table:
        """Part, phrase and language, and count, of the phrases of a batch."""
        langs = pa.array(runs.names, pa.large_string())
        total = np.bincount(runs.lang[runs.own], minlength=len(runs.names))
        seeds = np.zeros(len(total), np.uint64)
        seeds[runs.lang] = runs.seed
        out = [(seeds, langs, pa.array([""] * len(total), pa.large_string()), total)]
        good = None
        for n, (at, h) in enumerate(runs.hashes(), 1):
            ok = np.ones(len(at), bool) if n < 3 else good[at] & good[at + 1]
            ok[ok] = (short if n < 3 else long).value(h[ok])
            good = np.zeros(len(runs.words) + 1, bool)
            good[at[ok]] = True
            good[:len(runs.words)] |= ~runs.own
            at, h = at[ok], h[ok]
            if len(at):
                order = np.argsort(h, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
                lead = at[order[first]]
                out.append((h[order[first]], langs.take(pa.array(runs.lang[lead])), runs.phrases(lead, n),
                            np.diff(np.append(first, len(h)))))
        # a phrase has no line feed: what follows it is the language
        feed = pa.scalar("\n", pa.large_string())
        names = [pc.binary_join_element_wise(phrase, lang, feed) for _, lang, phrase, _ in out]
        return pa.table({"part": np.concatenate([split(h, parts)[0] for h, *_ in out]).astype(np.int64),
                         "name": pa.chunked_array(names), "f": np.concatenate([f for *_, f in out]).astype(np.int64)})

    def merged(held: list[pa.Table]) -> list[pa.Table]:
        t = pa.concat_tables(held).group_by(["part", "name"]).aggregate([("f", "sum")])
        return [t.select(["part", "name", "f_sum"]).rename_columns(["part", "name", "f"])]

    def lists(held: list[pa.Table]) -> pa.RecordBatch:
        """One row a hash partition."""
        t = merged(held)[0].sort_by("part").combine_chunks()
        part = t["part"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = pa.array(np.append(first, len(part)).astype(np.int32))
        name, f = (t[c].combine_chunks() for c in ("name", "f"))
        return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.ListArray.from_arrays(ends, name.cast(pa.string())),
                                           pa.ListArray.from_arrays(ends, f)], names=["p", "names", "f"])

    def count(batch_iter):
        held, size = [], 0
        for batch in batch_iter:
            for runs in _runs_of(batch):
                held.append(counts_of(runs))
                size += held[-1].num_rows
                if size > MERGE_ROWS:
                    held = merged(held)
                    size = held[0].num_rows
                    if size > 3 * MERGE_ROWS // 4:
                        yield lists(held)
                        held, size = [], 0
        if held:
            yield lists(held)

    def add(batch_iter):
        held, size, least = [], 0, 2 * MERGE_ROWS
        for batch in batch_iter:
            name = batch.column("names").flatten().cast(pa.large_string())
            held.append(pa.table({"part": pa.nulls(len(name), pa.int64()), "name": name, "f": batch.column("f").flatten()}))
            size += len(name)
            if size > least:
                held = merged(held)
                size = held[0].num_rows
                least = 2 * MERGE_ROWS + size
        if held:
            t = merged(held)[0]
            t = t.filter(pc.or_(pc.greater_equal(t["f"], threshold), pc.starts_with(t["name"], "\n")))
            for b in t.to_batches(max_chunksize=10_000):
                cut = [x.split("\n", 1) for x in b.column("name").to_pylist()]
                words = [len(c[0].split(" ")) if c[0] else 0 for c in cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[1] for c in cut], pa.string()), pa.array(words, pa.int32()),
                     pa.array([c[0] for c in cut], pa.string()), b.column("f")], names=["lang", "words", "phrase", "f"])

    dealt = rows.mapInArrow(count, "p long, names array<string>, f array<long>").repartition(1 << parts, "p")
    return dealt.mapInArrow(add, "lang string, words int, phrase string, f long")


def frequent_phrases(docs: DataFrame, threshold: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, phrase, f): all phrases of 1 to LONGEST words with f >= threshold, and each
    language's number of words under the empty phrase; written to the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("l"))
    parts = max(1, (text_bytes(rows, "t") // SHARE).bit_length())
    bits = max(3, min(FILTER_BITS, MOST_FILTER * 8 >> parts).bit_length() - 1)
    short = spark.sparkContext.broadcast(survivors(rows, parts, bits, threshold))
    long = spark.sparkContext.broadcast(survivors(rows, parts, bits, threshold, short))
    try:
        return written(exact_counts(rows, short, long, parts, threshold), "phrases")
    finally:
        short.destroy()
        long.destroy()


# ---- collocations -------------------------------------------------------------------------------------
def collocations(counts: DataFrame, threshold: int, top: int) -> DataFrame:
    """Each language's ``top`` phrases of two and more words by their weakest cut."""
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    known = counts.where((F.col("words") > 0) & (F.col("f") >= threshold))
    words = F.split("phrase", " ", -1)
    phrases = known.where("words > 1").withColumn("w", words)
    # a longer phrase as frequent as a part of it makes those between as frequent: one word more will do
    inner = (phrases.where("words > 2")
             .select("lang", "f", F.explode(F.array(F.slice("w", F.lit(1), F.col("words") - 1),
                                                    F.slice("w", F.lit(2), F.col("words") - 1))).alias("s"))
             .groupBy("lang", F.array_join("s", " ").alias("phrase")).agg(F.max("f").alias("longer")))
    free = (phrases.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") < F.col("f"))).drop("longer"))
    cuts = free.select("lang", "phrase", F.col("f").alias("a"), "w", "words",
                       F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("rest"))
    part = known.select("lang", "phrase", "f")
    big = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of two pass 64 bits
    scored = (cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
              .join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
              .join(total, "lang")
              .withColumn("up", (F.lit(1000).cast("decimal(4,0)") * big("a")) * big("n"))
              .withColumn("down", big("l") * big("r"))
              .withColumn("score", F.expr("up div down")))
    best = (scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    order = "score DESC, a DESC, phrase"
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = (salted.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt ORDER BY {order})"))
           .where(F.col("rank") <= top).drop("salt"))
    ranked = few.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang ORDER BY {order})").cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("lang", "text")
    return collocations(frequent_phrases(docs, 100), 100, 2000)

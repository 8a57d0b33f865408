"""Substring dedup by relative Lempel-Ziv parsing over words.

A word is removed if a window of 13 words that covers it also starts in a document with a smaller
id. Anchors (``anchors.py``) deal pieces of text into reference blocks, so that every block a
document can share a window with sees its piece. In each block, pieces are factored greedily in
order of document against the index of the earlier ones: at a place, the longest match with the
reference is one factor. Factors of 13 words or more are duplicate spans; the windows that cross a
factor's end are probed one by one, as another part of the reference may carry on there.

Defined cases: null text has no words; a null id comes after all others; rows with equal ids never
remove from each other; texts under 13 words keep everything; an empty table gives no rows; an input
column named like a result column is replaced, others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import anchors as A
from kestrel.llm.common import gram_hash, prefix, read, word_ranges, words_of

WIDTH = 13
GRAM = 6


def factor(rows: list[tuple], width: int = WIDTH):
    """(doc, start, length, hash) of the long factors of ``rows`` (h, doc, pos, content), parsed in
    order of document, each against the pieces of smaller documents."""
    out = ([], [], [], [])
    if not rows:
        return out
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    words, first, *_ = words_of([r[3] for r in rows])
    words |= np.uint64(1)
    seeds = gram_hash(prefix(words), width)
    row = np.repeat(np.arange(len(rows)), np.diff(first))
    places = np.flatnonzero(np.arange(len(seeds)) + width <= first[1:][row[: len(seeds)]])
    # the index: where each window stands first, that is in its smallest document
    _, where, which = np.unique(seeds[places], return_index=True, return_inverse=True)
    known = places[where][which]
    doc, pos = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
    hit = doc[row[known]] < doc[row[places]]
    at, there = places[hit], known[hit]
    values, found, free = memoryview(words), [], 0
    for a, t, end, stop in zip(at.tolist(), there.tolist(), first[row[at] + 1].tolist(), first[row[there] + 1].tolist()):
        if a < free:
            continue
        b, t = a + width, t + width
        while b < end and t < stop and values[b] == values[t]:
            b, t = b + 1, t + 1
        found.append((a, b))
        free = b - width + 1   # the windows inside the factor are repeats; next, those across its end
    if not found:
        return out
    a, b = np.array(found, np.int64).T
    j = row[a]
    return doc[j], pos[j] + a - first[j], b - a, A.span_hash(words, a, b)


def cut_words(text: bytes, pos: np.ndarray, length: np.ndarray) -> list[bytes]:
    start, end = word_ranges(np.frombuffer(text, np.uint8))
    return [b" ".join(text[a:b] for a, b in zip(start[p : p + n], end[p : p + n])) if p + n <= len(start) else b""
            for p, n in zip(pos.tolist(), length.tolist())]


def finish_words(texts: list[bytes], cuts: list[list[tuple[int, int]]]) -> list[pa.Array]:
    counts, removed, kept = [], [], []
    for text, spans in zip(texts, cuts):
        words = text.translate(_TO_SPACE).split(b" ")
        words = [w for w in words if w]
        counts.append(len(words))
        removed.append(sum(b - a for a, b in spans))
        edges = [0, *(x for s in spans for x in s), len(words)]
        kept.append(b" ".join(w for a, b in zip(edges[0::2], edges[1::2]) for w in words[a:b]))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
            pa.array([[{"start": a, "end": b} for a, b in s] for s in cuts], span_type),
            pa.array(kept, pa.binary()).cast(pa.string())]


_TO_SPACE = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def lz_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed, spans (removed word ranges) and kept (words joined by a space)."""
    return A.remove_repeats(
        docs, WIDTH, GRAM, A.word_symbols, cut_words, factor, finish_words,
        "n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string", id_col, text_col,
        "op5-found", A.MOST_PIECES)


def op5_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lz_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))

"""Suffix-array dedup of repeated byte strings, by difference-cover blockwise construction.

A byte is removed if a ``width``-byte string that covers it also starts in a document with a smaller
id. Anchors (``anchors.py``) bring together the pieces that can share such strings; each bucket of
pieces is then suffix-sorted one block at a time:

* the suffixes at the cover's residues (modulo 16) are ranked once, by prefix doubling;
* a block of suffixes is sorted by its first 16 bytes; longer ties are resolved by the ranks of the
  cover samples that the difference cover guarantees within the next 16 places, so no comparison
  reads further than that and memory holds one block besides the bucket's text;
* neighbours in suffix order with a common prefix of ``width`` bytes share a string, and the
  smallest document of each such run keeps it.

Defined cases: null text is empty; a null id comes after all others; rows with equal ids never
remove from each other; texts under ``width`` bytes keep everything; an empty table gives no rows;
an input column named like a result column is replaced, others pass through.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import anchors as A
from kestrel.llm.common import gram_hash, numbered, prefix, read

WIDTH = 50
GRAM = 24
PERIOD = 16
COVER = (0, 1, 2, 5, 8)      # every difference modulo 16 is one of two members
BLOCK = 1 << 20              # suffixes sorted at once


def cover_steps(period: int = PERIOD, cover: tuple = COVER) -> np.ndarray:
    """steps[r, s]: how far suffixes at residues r and s go on until both are cover samples."""
    member = np.isin(np.arange(period), cover)
    r, s = np.meshgrid(np.arange(period), np.arange(period), indexing="ij")
    steps = np.full((period, period), -1)
    for d in reversed(range(period)):
        steps[member[(r + d) % period] & member[(s + d) % period]] = d
    assert (steps >= 0).all(), "not a difference cover"
    return steps


def eights(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number that sorts like them; zeros after the end."""
    key = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for n in (1, 2, 4):
        key = (key[:-n] << np.uint64(8 * n)) | key[n:]
    return key[: len(text)]


class CoverRanks:
    """Ranks, up to ``depth`` bytes, of the suffixes at the cover's residues."""

    def __init__(self, key: np.ndarray, depth: int):
        n = len(key)
        places = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
        self.rank = np.zeros(n + 2 * PERIOD, np.int64)
        after = np.append(key, np.zeros(2 * PERIOD, np.uint64))
        hi, lo, reach = after[places], after[places + 8], PERIOD
        while True:
            order = np.lexsort((lo, hi))
            fresh = np.append(True, (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1]))
            place_rank = np.empty(len(places), np.int64)
            place_rank[order] = np.cumsum(fresh)
            self.rank[places] = place_rank
            if reach >= depth or fresh.all():
                return
            hi = place_rank.astype(np.uint64)
            lo = np.where(places + reach < n, self.rank[np.minimum(places + reach, n)], 0).astype(np.uint64)
            reach *= 2


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int, block: int = BLOCK):
    """Blocks of ``starts`` in the order of the suffixes there (compared up to ``depth`` bytes or
    the text's end), ascending across blocks; yields one sorted block at a time."""
    key = eights(text)
    after = np.append(key, np.zeros(PERIOD, np.uint64))
    ranks, steps = CoverRanks(key, depth).rank, cover_steps()
    head = key[starts]
    cuts = np.unique(np.quantile(head, np.linspace(0, 1, len(starts) // block + 2)[1:-1], method="nearest")) \
        if len(starts) > block else np.zeros(0, np.uint64)
    where = np.searchsorted(cuts, head, side="right")
    for b in range(len(cuts) + 1):
        at = starts[where == b] if len(cuts) else starts
        a, c, residue = key[at], after[at + 8], at % PERIOD
        own = ranks[at + steps[residue, residue]]
        order = np.lexsort((own, residue, c, a))
        at, a, c, residue = at[order], a[order], c[order], residue[order]
        begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))) if len(at) else []
        if len(at):  # ties at unlike residues: compare by the cover sample that both reach
            low, high = np.minimum.reduceat(residue, begin), np.maximum.reduceat(residue, begin)
            end = np.append(begin[1:], len(at))
            for i in np.flatnonzero(low != high):
                def longer(x, y):
                    d = steps[x % PERIOD, y % PERIOD]
                    return int(ranks[x + d] - ranks[y + d])
                at[begin[i] : end[i]] = sorted(at[begin[i] : end[i]].tolist(), key=cmp_to_key(longer))
        yield at


def compare_windows(rows: list[tuple], width: int = WIDTH, gram: int = GRAM):
    """(doc, start, length, hash) of the runs of windows in ``rows`` (h, doc, pos, content) that
    also start in a piece of a smaller document."""
    out = ([], [], [], [])
    if not rows:
        return out
    texts = [r[3] for r in rows]
    syms, offs = A.byte_symbols(texts)
    grams = gram_hash(prefix(syms), gram)
    low = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    ends = offs[1:] - gram + 1
    low = np.append(low, np.full(gram, np.iinfo(np.uint64).max, np.uint64))
    spans = np.empty(2 * len(texts), np.int64)
    spans[0::2], spans[1::2] = offs[:-1], ends
    anchor = (np.minimum.reduceat(low, spans)[0::2] & np.uint64(0xFFFFFFFF)).astype(np.int64) - offs[:-1]
    # anchors all lie at one residue: equal windows then tie at equal residues
    size = np.diff(offs)
    room = (size + PERIOD + 2 * PERIOD - 1) // PERIOD * PERIOD
    begin = np.concatenate([[0], np.cumsum(room)[:-1]]) + (-anchor) % PERIOD
    text = np.zeros(int(room.sum()) + PERIOD, np.uint8)
    inner = np.arange(offs[-1]) - np.repeat(offs[:-1], size)
    text[np.repeat(begin, size) + inner] = (syms - np.uint64(1)).astype(np.uint8)
    n_win = size - width + 1
    piece = np.repeat(np.arange(len(texts)), n_win)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    starts = begin[piece] + offset
    back = np.zeros(len(text), np.int64)
    back[starts] = np.arange(len(starts))
    doc = np.array([r[1] for r in rows], np.int64)
    key = eights(text)
    hit = np.zeros(len(starts), bool)
    for at in suffix_order(text, starts, int(size.max())):
        same = np.ones(max(len(at) - 1, 0), bool)
        for step in [*range(0, width - 7, 8), width - 8]:
            k = key[at + step]
            same &= k[1:] == k[:-1]
        run = np.flatnonzero(np.append(True, ~same))
        own = doc[piece[back[at]]]
        least = np.repeat(np.minimum.reduceat(own, run), np.diff(np.append(run, len(at))))
        hit[back[at]] = own > least
    idx = np.flatnonzero(hit)
    if not len(idx):
        return out
    fresh = np.flatnonzero(np.append(True, (np.diff(idx) != 1) | (piece[idx][1:] != piece[idx][:-1])))
    first, last = idx[fresh], idx[np.append(fresh[1:], len(idx)) - 1]
    p, a, length = piece[first], offset[first], offset[last] - offset[first] + width
    pos = np.array([r[2] for r in rows], np.int64)[p] + a
    return doc[p], pos, length, A.span_hash(syms, offs[p] + a, offs[p] + a + length)


def cut_bytes(text: bytes, pos: np.ndarray, length: np.ndarray) -> list[bytes]:
    return [text[p : p + n] if p + n <= len(text) else b"" for p, n in zip(pos.tolist(), length.tolist())]


def finish_bytes(texts: list[bytes], cuts: list[list[tuple[int, int]]]) -> list[pa.Array]:
    kept, removed = [], []
    for text, spans in zip(texts, cuts):
        edges = [0, *(x for s in spans for x in s), len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2])))
        removed.append(sum(b - a for a, b in spans))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
            pa.array([[{"start": a, "end": b} for a, b in s] for s in cuts], span_type), pa.array(kept, pa.binary())]


def finish_chars(texts: list[bytes], cuts: list[list[tuple[int, int]]]) -> list[pa.Array]:
    """As ``finish_bytes``, each span widened to whole characters."""
    inner = lambda text, at: at < len(text) and 0x80 <= text[at] < 0xC0
    wide = []
    for text, spans in zip(texts, cuts):
        out: list[tuple[int, int]] = []
        for a, b in spans:
            while a and inner(text, a):
                a -= 1
            while inner(text, b):
                b += 1
            if out and a <= out[-1][1]:
                a, b = out[-1][0], max(b, out[-1][1])
                out.pop()
            out.append((a, b))
        wide.append(out)
    return finish_bytes(texts, wide)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_chars: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, spans (removed byte ranges) and kept (remaining bytes). With
    ``whole_chars`` a character that a span cuts in two goes with it."""
    return A.remove_repeats(
        docs, WIDTH, GRAM, A.byte_symbols, cut_bytes, compare_windows, finish_chars if whole_chars else finish_bytes,
        "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary", id_col, text_col,
        "op10-found")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, without its repeated strings. A character that a span
    cuts in two goes with the span; a null text stays null. n_chars follows the text. All columns of
    the documents stay, whatever their names."""
    rows, names = numbered(docs, ("doc_id", "text", "n_chars"))
    out = suffix_dedup(rows, whole_chars=True)
    changed = F.col("n_removed") > 0
    out = out.withColumn("text", F.when(changed, F.col("kept").cast("string")).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names).toDF(*docs.columns)

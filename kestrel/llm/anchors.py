"""Repeats of W symbols across documents, found without shuffling every position.

Every run of W symbols picks one anchor in it: its smallest k-gram by hash. Equal runs pick the
same anchor, so two documents share a run only if they share the anchor. Runs next to each other
mostly pick the same one; together they are that anchor's *piece*. The steps, all keyed and
bounded:

1. each task finds its anchors and deals them out by hash; of equal pieces it sends only those of
   its smallest document (the others are repeats already), so a passage that a third of all
   documents share costs one record per task;
2. each bucket settles equal pieces the same way across tasks, and asks for the text of pieces that
   share an anchor without being equal;
3. the documents asked deliver those pieces, dealt out by anchor; if ``most`` is given, of an anchor
   with more of them they deliver every run of W symbols by its own hash, and of equal runs only
   those of a group's smallest document, so no bucket holds all surroundings of a common phrase.
   A piece of 20 words becomes 8 runs of 13, one of 76 bytes 27 of 50: op5 does so, op10 doesn't;
4. ``compare`` (the operator's own method) finds the repeated runs among them;
5. each document gets the spans to remove.

A piece's identity is 96 bits of hash (anchor 64, piece 32); spans carry a hash of what they cover
and apply only where that matches. Buckets and document groups are sized from the input's bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kestrel.llm.common import (NO_ID, chunks, gram_hash, mix, prefix, prime_at_least, range_hash, text_bytes, under_plain_names,
                                texts_of, words_of, written)

CHUNK = 1 << 18          # bytes of text hashed at once
HELD = 500_000           # anchors a task holds before it deals them out
PER_BUCKET = 4 << 20     # bytes of text for each bucket and document group
MOST_PIECES = 1 << 15    # unequal pieces of one anchor that meet in one bucket

RECORD = (("h", "u8"), ("ph", "u4"), ("doc", "i8"), ("pos", "u4"), ("len", "u2"))
SPAN = (("doc", "i8"), ("pos", "u4"), ("len", "u4"), ("ph", "u4"))
ASK = (("h", "u8"), ("doc", "i8"), ("pos", "u4"), ("len", "u2"), ("apart", "u1"))
RECORDS, SPANS, ASKS, PIECES = 0, 1, 2, 3
ROUTED = "bucket int, kind int, payload binary"


def pack(kind: tuple, cols: dict[str, np.ndarray]) -> bytes:
    """Columns in order of document; ids as differences, which compress well."""
    order = np.lexsort((cols["pos"], cols["doc"]))
    raw = [np.int64(len(order)).tobytes()]
    for name, dtype in kind:
        c = cols[name][order].astype(dtype)
        raw.append((np.diff(c, prepend=np.int64(0)) if name == "doc" else c).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpack(kind: tuple, payloads: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {name: [np.zeros(0, dtype)] for name, dtype in kind}
    for p in payloads:
        raw = zstandard.ZstdDecompressor().decompress(p)
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for name, dtype in kind:
            c = np.frombuffer(raw, dtype, n, at)
            at += c.nbytes
            parts[name].append(np.cumsum(c) if name == "doc" else c)
    return {name: np.concatenate(v) for name, v in parts.items()}


def pick(cols: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in cols.items()}


def find(symbols: np.ndarray, offs: np.ndarray, width: int, k: int) -> dict[str, np.ndarray]:
    """The anchors of texts that lie behind each other (text t: offs[t] to offs[t+1]): text number,
    hash, piece hash, and the piece's first symbol and length, counted within its text."""
    grams, w = np.zeros(0, np.uint64), width - k + 1
    if len(symbols) >= width:
        sums = prefix(symbols)
        grams = gram_hash(sums, k)
    n = len(grams) - w + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return {"text": none, "h": none.astype("u8"), "ph": none.astype("u4"), "pos": none, "len": none}
    # order by 32 bits of hash, then by place: equal runs see equal orders
    low = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: n], low[w - size : w - size + n])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    start = np.flatnonzero(np.arange(n) + width <= offs[1:][text])
    at, text = at[start], text[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    if not len(begin):
        return find(symbols[:0], offs[:1], width, k)
    first, end = start[begin], start[np.append(begin[1:], len(start)) - 1] + width
    piece = range_hash(sums, first, end) + (end - first).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    text = text[begin]
    return {"text": text, "h": grams[at[begin]], "ph": (mix(piece) >> np.uint64(32)).astype("u4"),
            "pos": first - offs[text], "len": end - first}


def span_hash(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    piece = range_hash(prefix(symbols), start, end) + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    return (mix(piece) >> np.uint64(32)).astype("u4")


def settle(r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of records: which are repeats of an equal piece of a smaller document, and each record's class."""
    key = mix(r["h"] + r["ph"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    begin = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    cls = np.empty(len(key), np.int64)
    cls[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
    least = np.minimum.reduceat(r["doc"][order], begin)
    return r["doc"] > least[cls], cls


def runs_apart(symbols: Callable, cut_pieces: Callable, width: int, pieces: list[tuple]) -> tuple[dict, list[tuple]]:
    """The runs of ``width`` symbols in ``pieces`` (doc, pos, content): spans of those that repeat a run of
    a smaller document here, and (hash, doc, pos, content) of the others."""
    syms, first = symbols([c for _, _, c in pieces])
    first = np.asarray(first, np.int64)
    count = np.maximum(np.diff(first) - width + 1, 0)
    piece = np.repeat(np.arange(len(pieces)), count)
    off = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    doc, pos = (np.array([x[i] for x in pieces], np.int64)[piece] for i in (0, 1))
    start = first[:-1][piece] + off
    runs = {"h": range_hash(prefix(syms), start, start + width), "ph": span_hash(syms, start, start + width),
            "doc": doc, "pos": pos + off, "len": np.full(len(piece), width, np.int64)}
    if not len(piece):
        return runs, []
    repeat, _ = settle(runs)
    rows = []
    rest = np.flatnonzero(~repeat)
    for i in np.split(rest, np.flatnonzero(np.diff(piece[rest])) + 1):
        if len(i):
            cut = cut_pieces(pieces[piece[i[0]]][2], off[i], runs["len"][i])
            rows += zip(runs["h"][i].tolist(), doc[i].tolist(), runs["pos"][i].tolist(), cut)
    return pick(runs, repeat), rows


def by_bucket(bucket: np.ndarray, cols: dict, kind: int, layout: tuple) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else []
    for a, b in zip(cut, [*cut[1:], len(order)]):
        yield int(bucket[order[a]]), kind, pack(layout, pick(cols, order[a:b]))


def routed(rows) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    for i in range(0, len(rows), 512):
        b, k, p = zip(*rows[i : i + 512])
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())],
                                         ["bucket", "kind", "payload"])


def table(rows) -> pa.Table:
    rows = list(rows)
    b, k, p = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())],
                    names=["bucket", "kind", "payload"])


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    return buf, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, first, *_ = words_of(texts)
    return words | np.uint64(1), first


def remove_repeats(docs: DataFrame, width: int, k: int, symbols: Callable, cut_pieces: Callable,
                   compare: Callable, finish: Callable, out_schema: str, id_col: str, text_col: str,
                   name: str, most: int | None = None) -> DataFrame:
    """``docs`` with the columns of ``out_schema`` from ``finish(texts, spans)``; see the module's text.

    symbols(texts): symbol values of a batch of texts and where each text begins.
    cut_pieces(text, positions, lengths): those pieces' contents, as bytes.
    compare(h, doc, pos, contents): (doc, start, length, hash) of the repeated spans.
    finish(texts, spans): the new columns; spans are merged (start, end) symbol ranges of each text.
    """
    return under_plain_names(docs, (id_col, text_col), lambda plain: _remove_repeats(
        plain, width, k, symbols, cut_pieces, compare, finish, out_schema, id_col, text_col, name, most))


def _remove_repeats(docs: DataFrame, width: int, k: int, symbols: Callable, cut_pieces: Callable,
                    compare: Callable, finish: Callable, out_schema: str, id_col: str, text_col: str,
                    name: str, most: int | None) -> DataFrame:
    size = text_bytes(docs, text_col)
    buckets, groups = prime_at_least(size // PER_BUCKET + 8), prime_at_least(size // PER_BUCKET + 12)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    slim = docs.select(key.alias("_doc"), F.col(text_col).cast("string").alias("_text"))

    def deal(held: list[dict]) -> Iterator[pa.RecordBatch]:
        r = {n: np.concatenate([x[n] for x in held]) for n, _ in RECORD}
        if not len(r["h"]):
            return
        repeat, _ = settle(r)
        again, rest = pick(r, repeat), pick(r, ~repeat)
        yield from routed(by_bucket(np.mod(again["doc"], groups), again, SPANS, SPAN))
        yield from routed(by_bucket((rest["h"] % np.uint64(buckets)).astype(np.int64), rest, RECORDS, RECORD))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            texts, ids = texts_of(batch, "_text"), batch.column("_doc").to_numpy(zero_copy_only=False)
            for a, b in chunks([len(t) for t in texts], CHUNK):
                found = find(*symbols(texts[a:b]), width, k)
                found["doc"] = ids[a:b][found.pop("text")]
                held.append({n: found[n].astype(t) for n, t in RECORD})
                count += len(found["h"])
                if count >= HELD:
                    yield from deal(held)
                    held, count = [], 0
        if held:
            yield from deal(held)

    def meet(t: pa.Table) -> pa.Table:
        kinds, payloads = t.column("kind").to_pylist(), t.column("payload").to_pylist()
        home = t.column("bucket")[0].as_py()
        rows = [(home, SPANS, p) for kd, p in zip(kinds, payloads) if kd == SPANS]
        r = unpack(RECORD, [p for kd, p in zip(kinds, payloads) if kd == RECORDS])
        if len(r["h"]):
            repeat, cls = settle(r)
            again, rest, cls = pick(r, repeat), pick(r, ~repeat), cls[~repeat]
            rows += by_bucket(np.mod(again["doc"], groups), again, SPANS, SPAN)
            # anchors with unequal pieces in at least two documents: only their text can tell
            order = np.argsort(rest["h"])
            h, begin = rest["h"][order], None
            begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            low, high = np.minimum.reduceat(rest["doc"][order], begin), np.maximum.reduceat(rest["doc"][order], begin)
            count = np.diff(np.append(begin, len(h)))
            open_, apart = np.zeros(len(h), bool), np.zeros(len(h), np.uint8)
            open_[order] = np.repeat(low < high, count)
            if most is not None:
                apart[order] = np.repeat(count > most, count)
            ask = pick({**rest, "apart": apart}, open_)
            rows += by_bucket(np.mod(ask["doc"], groups), ask, ASKS, ASK)
        return table(rows)

    def keys_of(d: pa.Table) -> list[int]:
        return d.column(id_col).cast(pa.int64()).fill_null(NO_ID).to_pylist()

    def dealt(rows: dict[int, list[tuple]]) -> Iterator[tuple]:
        for bkt, rs in rows.items():
            yield bkt, PIECES, zstandard.ZstdCompressor(level=1).compress(pieces_to(rs))

    def deliver(d: pa.Table, asked: pa.Table) -> pa.Table:
        want = unpack(ASK, [p for kd, p in zip(asked.column("kind").to_pylist(), asked.column("payload").to_pylist())
                            if kd == ASKS])
        if not len(want["h"]):
            return table([])
        order = np.argsort(want["doc"], kind="stable")
        want = pick(want, order)
        docs_, texts, rows, common = keys_of(d), texts_of(d, text_col), {}, []
        for doc, text in zip(docs_, texts):
            a, b = np.searchsorted(want["doc"], doc), np.searchsorted(want["doc"], doc, side="right")
            if a == b:
                continue
            cut = cut_pieces(text, want["pos"][a:b].astype(np.int64), want["len"][a:b].astype(np.int64))
            for i, c in zip(range(a, b), cut):
                if c and want["apart"][i]:
                    common.append((doc, int(want["pos"][i]), c))
                elif c:
                    h = int(want["h"][i])
                    rows.setdefault(h % buckets, []).append((h, doc, int(want["pos"][i]), c))
        out = list(dealt(rows))
        for a, b in chunks([len(c) for _, _, c in common], CHUNK):
            again, apart = runs_apart(symbols, cut_pieces, width, common[a:b])
            out += by_bucket(np.mod(again["doc"], groups), again, SPANS, SPAN)
            rows = {}
            for row in apart:
                rows.setdefault(row[0] % buckets, []).append(row)
            out += dealt(rows)
        return table(out)

    def judge(t: pa.Table) -> pa.Table:
        kinds, payloads = t.column("kind").to_pylist(), t.column("payload").to_pylist()
        home = t.column("bucket")[0].as_py()
        spans = [(home, SPANS, p) for kd, p in zip(kinds, payloads) if kd == SPANS]
        rows = [r for kd, p in zip(kinds, payloads) if kd == PIECES
                for r in pieces_from(zstandard.ZstdDecompressor().decompress(p))]
        doc, pos, length, ph = compare(rows)
        cols = {"doc": np.asarray(doc, np.int64), "pos": np.asarray(pos, np.int64),
                "len": np.asarray(length, np.int64), "ph": np.asarray(ph, np.uint32)}
        return table([*spans, *by_bucket(np.mod(cols["doc"], groups), cols, SPANS, SPAN)])

    out_cols = StructType.fromDDL(out_schema).fieldNames()
    rest_cols = [c for c in docs.columns if c not in out_cols]
    # one frame for both cogroups below, so that the documents are shuffled once and the exchange is reused
    plain = [F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`")
             for c in dict.fromkeys([*rest_cols, id_col, text_col])]
    whole = docs.select(*plain, F.pmod(key, F.lit(groups)).cast("int").alias("__group__"))
    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*plain).schema.fields
                            if f.name in rest_cols)

    def apply(d: pa.Table, marks: pa.Table) -> pa.Table:
        spans = unpack(SPAN, [p for kd, p in zip(marks.column("kind").to_pylist(), marks.column("payload").to_pylist())
                              if kd == SPANS])
        spans = pick(spans, np.argsort(spans["doc"], kind="stable"))
        docs_, texts = keys_of(d), texts_of(d, text_col)
        cuts = []
        for doc, text in zip(docs_, texts):
            a = np.searchsorted(spans["doc"], doc)
            b = np.searchsorted(spans["doc"], doc, side="right")
            cuts.append(merged(symbols, text, pick(spans, slice(a, b))) if b > a else [])
        new = finish(texts, cuts)
        return pa.table([*[d.column(c) for c in rest_cols], *new], names=[*rest_cols, *out_cols])

    found = written(slim.mapInArrow(scan, ROUTED).groupBy("bucket").applyInArrow(meet, ROUTED), name)
    # ask first: every document group delivers, and each anchor's pieces meet in one bucket
    delivered = (whole.groupBy("__group__")
                 .cogroup(found.where(F.col("kind") == ASKS).groupBy("bucket")).applyInArrow(deliver, ROUTED))
    judged = delivered.groupBy("bucket").applyInArrow(judge, ROUTED)
    marks = found.where(F.col("kind") == SPANS).unionByName(judged)
    schema = ", ".join(x for x in (kept_schema, out_schema) if x)
    return whole.groupBy("__group__").cogroup(marks.groupBy("bucket")).applyInArrow(apply, schema)


def merged(symbols: Callable, text: bytes, spans: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """Union of the spans that hold here, as sorted, disjoint (start, end) with gaps between."""
    syms, _ = symbols([text])
    start = spans["pos"].astype(np.int64)
    end = start + spans["len"].astype(np.int64)
    ok = end <= len(syms)
    start, end, ph = start[ok], end[ok], spans["ph"][ok]
    if not len(start):
        return []
    ok = span_hash(syms, start, end) == ph
    edge = np.zeros(len(syms) + 1, np.int64)
    np.add.at(edge, start[ok], 1)
    np.add.at(edge, end[ok], -1)
    inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    step = np.diff(inside)
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def pieces_to(rows: list[tuple]) -> bytes:
    head = np.array([(h, d, p, len(c)) for h, d, p, c in rows],
                    dtype=[("h", "u8"), ("doc", "i8"), ("pos", "u4"), ("len", "u4")])
    return np.int64(len(rows)).tobytes() + head.tobytes() + b"".join(r[3] for r in rows)


def pieces_from(raw: bytes) -> list[tuple]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    dtype = np.dtype([("h", "u8"), ("doc", "i8"), ("pos", "u4"), ("len", "u4")])
    head = np.frombuffer(raw, dtype, n, 8)
    ends = np.cumsum(head["len"].astype(np.int64)) + 8 + n * dtype.itemsize
    return [(h, d, p, raw[e - s : e]) for h, d, p, s, e in zip(
        head["h"].tolist(), head["doc"].tolist(), head["pos"].tolist(), head["len"].tolist(), ends.tolist())]


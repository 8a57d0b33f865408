"""Token ids as files of range-coded blocks (static rANS), in order of document.

Pass one encodes the texts, range-partitioned by id, into blocks of whole documents (about
BLOCK_IDS ids; a longer document is a block) and counts ids. The counts of all blocks make one
shared frequency table that sums to 2**SCALE. Pass two codes every block on its own: its ids are
dealt over LANES interleaved coder states that share one stream of 32-bit words, and every CHECK
rows the states and the place in the stream are kept as a checkpoint, so the segments between
checkpoints decode side by side. A block carries CRCs of its bytes, its ids and the table it needs;
decoding refuses a block that doesn't match.

File format: a Parquet table of blocks (part, seq, offset in part, payload) beside a table with one
row, the frequency table. A payload, little-endian: magic "RNS1", counts and CRCs (HEAD), document
ids (int64) and lengths (uint32), checkpoints (stream place uint32, states uint64 x LANES), words
(uint32).

Defined cases: null and empty texts hold the end id alone; a null id comes last; rows with one id
follow each other in order of text hash; repeated rows are coded as often as they occur; an empty
table gives an empty file and no rows; other input columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import NO_ID, chunks, read, text_bytes, texts_of, written
from kestrel.llm.forced_bpe import CHUNK, SpacedBpe, coder
from kestrel.llm.forced_bpe import vocabulary as vocabulary_path

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2
SCALE = 20
LANES = 1024
CHECK = 128                # rows of LANES ids between checkpoints
BLOCK_IDS = 1 << 18
PER_PART = 24 << 20        # bytes of text in a range partition
LOW = np.uint64(1 << 31)
HEAD = np.dtype([("magic", "S4"), ("ids", "<u4"), ("docs", "<u4"), ("lanes", "<u4"), ("check", "<u4"),
                 ("words", "<u4"), ("marks", "<u4"), ("table_crc", "<u4"), ("ids_crc", "<u4"), ("body_crc", "<u4")])


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Shares of 2**SCALE, at least 1 for every id that occurs."""
    total, seen = counts.sum(), counts > 0
    if not total:
        return np.zeros(len(counts), np.uint32)
    f = np.where(seen, np.maximum(1, counts * (1 << SCALE) // total), 0).astype(np.int64)
    over = int(f.sum()) - (1 << SCALE)
    order = np.argsort(-f, kind="stable")
    if over < 0:
        f[order[0]] -= over
    while over > 0:            # take from the largest, never below 1
        take = np.minimum(np.maximum(f[order] - 1, 0), over // 64 + 1)
        take = np.where(np.cumsum(take) <= over, take, np.maximum(0, over - (np.cumsum(take) - take)))
        f[order] -= take
        over -= int(take.sum())
    return f.astype(np.uint32)


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._slot = None

    @property
    def slot(self) -> np.ndarray:
        if self._slot is None:
            self._slot = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slot

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Words in reading order, and checkpoints (place, states) before rows 0, CHECK, 2 CHECK ..."""
        rows = -(-len(ids) // LANES)
        x = np.full(LANES, LOW, np.uint64)
        here = ids.astype(np.int64)
        f, c = self.freq.take(here), self.start.take(here)
        limit, bits, low32 = f << np.uint64(63 - SCALE), np.uint64(SCALE), np.uint64(32)
        words, sizes, states = [], np.zeros(rows, np.int64), {}
        for r in range(rows - 1, -1, -1):
            part = slice(r * LANES, min((r + 1) * LANES, len(ids)))
            v = x[: part.stop - part.start]
            full = v >= limit[part]
            out = v[full]
            words.append(out.astype(np.uint32))
            sizes[r] = len(out)
            v = np.where(full, v >> low32, v)
            q = v // f[part]
            x[: len(v)] = (q << bits) + (v - q * f[part]) + c[part]
            if r % CHECK == 0:
                states[r] = x.copy()
        place = np.concatenate([[0], np.cumsum(sizes)])
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        return stream, [(int(place[r]), states[r]) for r in sorted(states)]

    def decode(self, n: int, lanes: int, check: int, places: np.ndarray, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """All segments side by side, one row of lanes each per step."""
        if not n:
            return np.zeros(0, np.uint32)
        rows, segments = -(-n // lanes), len(places)
        out = np.zeros((segments, check, lanes), np.uint32)
        x, at = states.astype(np.uint64).copy(), places.astype(np.int64).copy()
        words = np.append(words, np.zeros(lanes, np.uint32)).astype(np.uint64)
        mask, bits, low32 = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        first_row = np.arange(segments) * check
        for r in range(min(check, rows)):
            live = int(np.searchsorted(first_row + r, rows))     # the last segment may be over
            v = x[:live]
            slot = v & mask
            ids = self.slot.take(slot.view(np.int64))
            here = ids.astype(np.int64)
            new = self.freq.take(here) * (v >> bits) + slot - self.start.take(here)
            need = new < LOW
            if (first_row[live - 1] + r + 1) * lanes > n:
                used = (first_row[:live] + r)[:, None] * lanes + np.arange(lanes) < n
                need &= used
                new = np.where(used, new, v)
            for k in range(live):
                put = np.flatnonzero(need[k])
                new[k, put] = (new[k, put] << low32) | words[at[k] : at[k] + len(put)]
                at[k] += len(put)
            x[:live] = new
            out[:live, r] = ids
        return out.reshape(-1)[:n] if rows >= check else out[:, :rows].reshape(-1)[:n]

    def block(self, docs: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
        words, marks = self.encode(ids)
        body = b"".join([docs.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(),
                         np.array([p for p, _ in marks], "<u4").tobytes(),
                         b"".join(s.astype("<u8").tobytes() for _, s in marks), words.astype("<u4").tobytes()])
        head = np.array([(b"RNS1", len(ids), len(docs), LANES, CHECK, len(words), len(marks), self.crc,
                          zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body))], HEAD)
        return head.tobytes() + body

    def read(self, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document ids, lengths, token ids) of a block; ValueError if anything doesn't match."""
        if len(payload) < HEAD.itemsize:
            raise ValueError("block is cut short")
        h = np.frombuffer(payload, HEAD, 1)[0]
        if h["magic"] != b"RNS1" or zlib.crc32(payload[HEAD.itemsize :]) != h["body_crc"]:
            raise ValueError("block is damaged")
        if h["table_crc"] != self.crc:
            raise ValueError("block needs another frequency table")
        at, out = HEAD.itemsize, []
        for dtype, n in (("<i8", h["docs"]), ("<u4", h["docs"]), ("<u4", h["marks"]),
                         ("<u8", int(h["marks"]) * int(h["lanes"])), ("<u4", h["words"])):
            out.append(np.frombuffer(payload, dtype, int(n), at))
            at += out[-1].nbytes
        docs, lengths, places, states, words = out
        ids = self.decode(int(h["ids"]), int(h["lanes"]), int(h["check"]), places,
                          states.reshape(len(places), -1) if len(places) else states, words)
        if zlib.crc32(ids.astype("<u4").tobytes()) != h["ids_crc"]:
            raise ValueError("ids differ from those encoded")
        return docs, lengths, ids


def _column(values, kind) -> pa.Array:
    return pa.array(values, kind)


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE,
                 end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` as blocks; returns the written (blocks, frequency table)."""
    parts, path = text_bytes(docs, text_col) // PER_PART + 6, vocabulary_path(vocabulary)
    ordered = (docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                           F.col(text_col).cast("string").alias("text"))
               .repartitionByRange(parts, "doc", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
               .sortWithinPartitions("doc", F.xxhash64("text")))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, SpacedBpe)
        end = np.array([end_id], bpe.code).tobytes()
        held, lengths, ids, count, seq, offset, part = [], [], [], 0, 0, 0, 0
        width = np.dtype(bpe.code).itemsize

        def block():
            raw = np.frombuffer(b"".join(ids), bpe.code)
            hist = np.bincount(raw)
            seen = np.flatnonzero(hist)
            return pa.RecordBatch.from_arrays([
                _column([part], pa.int32()), _column([seq], pa.int32()), _column([offset], pa.int64()),
                _column([np.array(held, np.int64).tobytes()], pa.binary()),
                _column([np.array(lengths, np.uint32).tobytes()], pa.binary()),
                _column([raw.astype(np.uint32).tobytes() if width > 2 else raw.tobytes()], pa.binary()),
                _column([width], pa.int32()), _column([seen.astype(np.uint32).tobytes()], pa.binary()),
                _column([hist[seen].astype(np.int64).tobytes()], pa.binary())],
                ["part", "seq", "at", "docs", "lengths", "ids", "width", "seen", "hist"])

        for batch in batches:
            col = texts_of(batch, "text")
            doc = batch.column("doc").to_pylist()
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for lo, hi in chunks([len(t) + 64 for t in col], CHUNK):
                for d, raw in zip(doc[lo:hi], bpe.encode(col[lo:hi])):
                    n = len(raw) // width + 1
                    if held and count + n > BLOCK_IDS:
                        yield block()
                        seq, offset, held, lengths, ids, count = seq + 1, offset + count, [], [], [], 0
                    held.append(d)
                    lengths.append(n)
                    ids += [raw, end]
                    count += n
        if held:
            yield block()

    raw = written(ordered.mapInArrow(tokens, "part int, seq int, at long, docs binary, lengths binary, ids binary, "
                                             "width int, seen binary, hist binary"), "op2-ids")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for s, h in zip(batch.column("seen").to_pylist(), batch.column("hist").to_pylist()):
                s, h = np.frombuffer(s, np.uint32), np.frombuffer(h, np.int64)
                if len(s) and s[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(s[-1]) + 1 - len(total), np.int64)])
                total[s] += h
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([_column(seen, pa.int64()), _column(total[seen], pa.int64())], ["id", "n"])

    counts = (raw.select("seen", "hist").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")))
    found = counts.toArrow()       # one row per id of the vocabulary
    ids, n = found["id"].to_numpy(), found["n"].to_numpy()
    full = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    full[ids] = n
    freq = frequencies(full)
    table = docs.sparkSession.createDataFrame([(bytearray(freq.astype("<u4").tobytes()),)], "freq binary")
    shared = docs.sparkSession.sparkContext.broadcast(freq)      # as large as the vocabulary

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Table(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("part", "seq", "at", "docs", "lengths", "ids", "width")}
                ids = np.frombuffer(row["ids"], np.uint16 if row["width"] == 2 else np.uint32)
                payload = coder.block(np.frombuffer(row["docs"], np.int64), np.frombuffer(row["lengths"], np.uint32), ids)
                yield pa.RecordBatch.from_arrays([
                    _column([row["part"]], pa.int32()), _column([row["seq"]], pa.int32()),
                    _column([row["at"]], pa.int64()), _column([len(ids)], pa.int64()),
                    _column([payload], pa.binary())], ["part", "seq", "at", "n", "payload"])

    blocks = written(raw.select("part", "seq", "at", "docs", "lengths", "ids", "width")
                     .mapInArrow(code, "part int, seq int, at long, n long, payload binary"), "op2-blocks")
    return blocks, written(table, "op2-table")


def read_tokens(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, decoded from the written blocks."""
    spark = blocks.sparkSession
    freq = np.frombuffer(bytes(table.first()["freq"]), "<u4")
    shared = spark.sparkContext.broadcast(freq)
    totals = sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n")).collect()))   # one row per partition
    begin, rows = 0, []
    for part, n in totals:
        rows.append((part, begin))
        begin += n
    starts = spark.createDataFrame(rows, "part int, begin long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Table(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                docs, lengths, ids = coder.read(batch.column("payload")[i].as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                at = batch.column("begin")[i].as_py() + batch.column("at")[i].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, mask=docs == NO_ID), pa.array(at + ends - lengths), pa.array(lengths.astype(np.int64)),
                    _column([zlib.crc32(o) for o in own], pa.int64()), _column(own, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return (blocks.join(F.broadcast(starts), "part").select("begin", "at", "payload")
            .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"))


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(*write_tokens(read(spark, sf_dir, "documents"))).drop("ids")

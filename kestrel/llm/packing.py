"""Packing documents into sequences of at most CAPACITY tokens by sums of squares.

A document's ids end in END_ID; one longer than a sequence is cut into pieces of CAPACITY, the last
shorter. Pieces are dealt by hash into groups of about GROUP pieces, each packed in one task: in
order of falling length, a piece goes onto the open sequence where the sum over all fill levels of
(open sequences at that level) squared becomes least, of equal choices onto the fullest; a new
sequence is opened only where it fits onto none. Full sequences are closed and count no more. A group keeps one counter per level,
so a choice costs one pass over CAPACITY counters, whatever the number of open sequences. Groups
don't share sequences, which leaves at most a few open ones per GROUP pieces.

Defined cases: null and empty texts hold the end id alone; rows without an id are packed as well;
repeated rows are packed as often as they occur; an empty table gives no rows; other input columns
are not carried along.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import NO_ID, chunks, read, texts_of, written
from kestrel.llm.forced_bpe import CHUNK, coder
from kestrel.llm.forced_bpe import vocabulary as vocabulary_path

WORD_BPE = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096
GROUP = 60_000

PIECES = "doc long, piece int, start long, length long, ids_crc32 long"


def place(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each piece; lengths are 1 to ``capacity``, in the order to place them."""
    count = np.zeros(capacity + 1, np.int64)          # open sequences by fill level
    open_: dict[int, list[int]] = defaultdict(list)   # fill level -> sequences
    never = np.int64(1) << 40
    cost = np.empty(capacity + 1, np.int64)
    seqs, offsets, made = [], [], 0
    for n in lengths:
        room = capacity - n
        # change of the sum: level h loses one sequence, level h + n gains one (none if it is full)
        c = cost[: room + 1]
        np.subtract(count[n:], count[: room + 1], out=c)
        c *= 2
        c += 2
        c[room] = 1 - 2 * count[room]
        c[count[: room + 1] == 0] = never
        c[0] = never - 1                              # a new sequence, where it fits onto none
        h = room - int(c[::-1].argmin())
        if h:
            s = open_[h].pop()
            count[h] -= 1
        else:
            s, made = made, made + 1
        seqs.append(s)
        offsets.append(h)
        if h < room:
            open_[h + n].append(s)
            count[h + n] += 1
    return seqs, offsets


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE,
                 end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    path = vocabulary_path(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        end = np.array([end_id], bpe.code).tobytes()
        for batch in batches:
            texts, doc = texts_of(batch, "text"), batch.column("doc").to_pylist()
            out = ([], [], [], [], [])
            for lo, hi in chunks([len(t) + 64 for t in texts], CHUNK):
                for d, raw in zip(doc[lo:hi], bpe.encode(texts[lo:hi])):
                    ids = np.frombuffer(raw + end, bpe.code).astype("<u4")
                    for k, a in enumerate(range(0, len(ids), capacity)):
                        part = ids[a : a + capacity]
                        for o, v in zip(out, (d, k, a, len(part), zlib.crc32(part.tobytes()))):
                            o.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)],
                                             ["doc", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = written(token_pieces(docs, id_col, text_col), "op6-pieces")
    groups = -(-pieces.count() // GROUP) or 1

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        t = t.sort_by([("length", "descending"), ("doc", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        seqs, offsets = place(t.column("length").to_pylist())
        first = t.column("group")[0].as_py() << 40
        doc = t.column("doc").to_numpy()
        out = pa.table([pa.array(doc, mask=doc == NO_ID), *[t.column(c) for c in ("piece", "start", "length", "ids_crc32")],
                        pa.array(np.array(seqs, np.int64) + first), pa.array(offsets, pa.int64())],
                       names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
        yield from out.to_batches()

    return (pieces.repartition(groups, F.xxhash64("doc", "piece", F.monotonically_increasing_id())).withColumn("group", F.spark_partition_id().cast("long"))
            .mapInArrow(fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents, packed."""
    return pack(docs)

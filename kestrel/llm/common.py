"""Shared pieces of the training-data operators: shared-folder tables and vectorised text hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir

#: Documents without an id take part under this one, after every other document.
NO_ID = (1 << 63) - 1
#: Words are the maximal runs of characters other than space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INV = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: later steps
    start from files that every executor sees, so a lost executor costs no recomputation."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that earlier tasks of this Python worker freed goes back to the system: workers are used again,
    and the C library keeps it for them otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def numbered(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns but ``keep`` renamed by position, and the new names: nothing that a stage
    adds can clash with a document column. ``toDF`` with the old names undoes it."""
    names = [c if c in keep else f"in_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def under_plain_names(docs: DataFrame, keep: tuple[str, ...], operator) -> DataFrame:
    """``operator`` on ``docs`` with all columns but ``keep`` renamed by position, and their names put back:
    they pass through whatever they are called. An input column named as an output is replaced by it."""
    plain, names = numbered(docs, keep)
    out, back = operator(plain), dict(zip(names, docs.columns))
    added = [c for c in out.columns if c not in back]
    stay = [c for c in out.columns if c in back and back[c] not in added]
    return out.select(*stay, *added).toDF(*[back[c] for c in stay], *added)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts; partition and bucket counts are derived from it."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def prime_at_least(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def fixed_hash(key: str, parts: int, salt: str = "") -> "F.Column":
    return F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(parts)).cast("int")


# ---- vectorised hashing ---------------------------------------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words (a bijection with good avalanche); wraps around on purpose."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64; kept for the next batch."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for slot, base in enumerate((_BASE, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[slot] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol * base**i: any range's polynomial hash is one subtraction away."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k symbols."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[k:] - sums[:n]) * powers(len(sums))[1][:n])


def joined(texts: list[bytes], gap: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """All texts behind each other as bytes, and where each begins (one entry more than texts)."""
    sizes = np.fromiter((len(t) + len(gap) for t in texts), np.int64, len(texts))
    return np.frombuffer(gap.join([*texts, b""]) if texts else b"", np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def word_ranges(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; separators are ASCII, so bytes of UTF-8 will do."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each text, bytes, word starts, word ends) of a batch of texts."""
    buf, offs = joined(texts, b" ")
    start, end = word_ranges(buf)
    sums = prefix(buf.astype(np.uint64) + np.uint64(1))
    return range_hash(sums, start, end), np.searchsorted(start, offs), buf, start, end


def word_grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word runs inside the texts, and the first gram of each text. A text of
    fewer than n words, but at least one, has one gram: all its words."""
    sums = prefix(words | np.uint64(1))
    count = np.diff(first)
    start = np.arange(len(words), dtype=np.int64)
    text = np.repeat(np.arange(len(count)), count)
    last = first[1:][text]
    ok = (start + n <= last) | (start == first[:-1][text])
    start, text, last = start[ok], text[ok], last[ok]
    grams = range_hash(sums, start, np.minimum(start + n, last))
    return grams, np.searchsorted(text, np.arange(len(count) + 1))


def chunks(sizes: list[int], most: int):
    """Consecutive index ranges whose sizes sum to about ``most``; a larger item stands alone."""
    begin, total = 0, 0
    for i, s in enumerate(sizes):
        if i > begin and total + s > most:
            yield begin, i
            begin, total = i, 0
        total += s
    if begin < len(sizes):
        yield begin, len(sizes)


def texts_of(batch: pa.RecordBatch | pa.Table, column: str) -> list[bytes]:
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return [b"" if t is None else t for t in col.cast(pa.binary()).to_pylist()]


# ---- plain tokens: lower-cased runs of letters and digits --------------------------------------------
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256)], np.uint8)


def tokens_of(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the plain tokens of all texts, and the first token of each text. ASCII letters are
    lower-cased; bytes of other scripts count as letters. With ``prefixes``, tokens x (1 + number of
    them): the token and its first bytes of those lengths, 0 where it is no longer than that."""
    buf, offs = joined(texts, b" ")
    plain = _PLAIN[buf]
    start, end = word_ranges(plain)
    sums = prefix(plain.astype(np.uint64))
    out, first = range_hash(sums, start, end), np.searchsorted(start, offs)
    if prefixes:
        heads = [np.where(start + n < end, range_hash(sums, start, np.minimum(start + n, end)) + np.uint64(n), 0)
                 for n in prefixes]
        out = np.stack([out, *heads], axis=1)
    return out, first


def in_test_fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, t, _y), t the text's bytes, of at most ``per_class`` labelled documents of each class
    outside the test fold, those of least id hash, texts up to ``most_bytes`` each; deterministic."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~in_test_fold())
             .groupBy("doc_id").agg(F.max(label).alias("_y")))
    picked = None
    for y in (0, 1):
        top = known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = top if picked is None else picked.unionByName(top)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("_t"))
    if most_bytes is not None:
        rows = rows.where(F.octet_length("_t") <= most_bytes)
    else:
        rows = rows.where("_t is not null")
    return (rows.join(F.broadcast(picked), "doc_id")      # bounded by per_class
            .select("doc_id", F.col("_t").cast("binary").alias("t"), "_y"))

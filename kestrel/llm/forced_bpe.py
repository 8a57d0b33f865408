"""Byte-pair encoding and decoding by forced boundaries.

A merge can only join two neighbouring bytes that stand side by side inside some token of the
vocabulary. Where two neighbouring bytes do so in no token, no merge ever spans them: the place is a
certain cut, and the fragments on its two sides are encoded independently and concatenated. With
the cuts that the vocabulary's own splitting rule makes (white space, changes between letters,
digits and other characters) a text falls into short fragments, few of them different; a worker
encodes each fragment once and keeps its ids (at most about HELD; those not met of late are dropped).

A fragment at the end of a pre-token carries the vocabulary's word-end mark, one before a forced
cut does not: the two are encoded by two models with the same merges, one without the mark.
Runs of non-space with an apostrophe or a character beyond ASCII, Latin and Cyrillic letters are
normalised and split by the library (Unicode classes, contractions) and then cut at the same pairs. Texts that hold an added token
(as <|endoftext|>) or the marks used here, U+0001 and U+0002, are encoded by the library as they are.

Defined cases: a null text is the empty text, which has no ids and decodes to the empty string.
Null or repeated ids and repeated rows give one row each; other columns pass through, and one with
an output's name is replaced by the output. Row-local: no shuffle, nothing grows with the data but
the memo, which is bounded. A text is held whole, with its ids.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from kestrel.llm.common import chunks, joined, read

WORD_BPE = "word_bpe_49k.json"
HELD = 500_000
CHUNK = 2 << 20
INNER = b"\x01"  # ends a fragment that is followed by a forced cut
RUN = b"\x02"    # begins a run that the library splits

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.int8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = _SPACE if _c in " \t\n\x0b\x0c\r" else _LETTER if _c.isalpha() else _DIGIT if _c.isdigit() else _OTHER
_CLASS_OF = _CLASS.tobytes()
_FOLD = np.array([b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256)], np.uint8)
_RISKY = np.zeros(256, bool)
_RISKY[128:] = True
_RISKY[ord("'")] = True
# Letters of two bytes that composition leaves alone and whose lower case has two bytes: U+00C0 to
# U+01FF and U+0400 to U+047F without the two signs among them and the dotted capital I.
_LETTERS = [c for c in [*range(0xC0, 0x200), *range(0x400, 0x480)] if c not in (0xD7, 0xF7, 0x130)]
_PAIR_FOLD = np.zeros(1 << 16, np.uint16)  # by the two bytes; 0: not such a letter
for _c in _LETTERS:
    _PAIR_FOLD[int.from_bytes(chr(_c).encode())] = int.from_bytes(chr(_c).lower().encode())


def byte_characters() -> list[str]:
    """The characters that byte-level vocabularies write the bytes 0 to 255 with: printable ones of
    Latin-1 stand for themselves, the others, in order, for the characters from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def inner_pairs(tokens: list[str], end_mark: str) -> np.ndarray:
    """inside[a, b]: some token holds byte a directly before byte b. All other pairs are certain cuts."""
    byte = {c: i for i, c in enumerate(byte_characters())}
    inside = np.zeros((256, 256), bool)
    for t in tokens:
        t = t[: -len(end_mark)] if end_mark and t.endswith(end_mark) else t
        b = [byte[c] for c in t if c in byte]
        inside[b[:-1], b[1:]] = True
    return inside


class Memo(dict):
    """Ids by fragment; one that is missing is taken over from the memo before, or learned."""

    def __init__(self, learn, before: dict[bytes, bytes]):
        super().__init__()
        self.learn, self.before = learn, before

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.learn(piece) if piece else b""
        self[piece] = ids
        return ids


class ForcedBpe:
    """Vocabularies with a word-end mark that drop white space."""

    word_ends = True

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        mark = model.get("end_of_word_suffix") or ""
        if spec["truncation"] or spec["padding"] or model["type"] != "BPE" or bool(mark) != self.word_ends:
            raise ValueError(f"{path}: not a vocabulary for {type(self).__name__}")
        self.tok = Tokenizer.from_file(path)
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.ending = self.tok.model
        self.inner = BPE(vocab=model["vocab"], merges=merges)
        self.inside = inner_pairs(list(model["vocab"]), mark)
        self.characters = byte_characters()
        self.bytes_of = {c: i for i, c in enumerate(self.characters)}
        self.written = "".join(self.characters)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        signs, patterns = self.own_way()
        self.signs = [*(a.encode() for a in added), *signs]
        self.special = re.compile(b"|".join([*(re.escape(a.encode()) for a in added), *patterns]))
        size = max([*model["vocab"].values(), *self.tok.get_added_tokens_decoder()]) + 1
        self.code = "H" if size <= 1 << 16 else "I"
        self.names = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.memo = Memo(self.learn, {})

    def own_way(self) -> tuple[list[bytes], list[bytes]]:
        """Bytes that may mean, and patterns that do mean, that the library encodes a text as it is."""
        return [INNER, RUN], [INNER, RUN]

    def special_of(self, texts: list[bytes]) -> set[int]:
        """The texts that the library encodes as they are."""
        every = b"".join(texts)     # a sign across two texts only costs the second look
        signs = [s for s in self.signs if s in every]
        return {i for i, t in enumerate(texts) if any(s in t for s in signs) and self.special.search(t)} if signs else set()

    # ---- one fragment ------------------------------------------------------------------------------
    def fragment(self, piece: str, last: bool) -> bytes:
        """Ids of a fragment, written in the byte characters."""
        model = self.ending if last else self.inner
        return array(self.code, [t.id for t in model.tokenize(piece)]).tobytes()

    def forced(self, word: str) -> list[str]:
        """A pre-token in the byte characters, cut at every forced boundary."""
        at = [self.bytes_of[c] for c in word]
        cuts = [i + 1 for i in range(len(at) - 1) if not self.inside[at[i], at[i + 1]]]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def run(self, piece: bytes) -> bytes:
        """Ids of a run of non-space that the library splits."""
        out = []
        for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(piece.decode())):
            parts = self.forced(word)
            for k, part in enumerate(parts):
                last = k == len(parts) - 1
                key = part.encode() + b" " + (b"" if last else INNER)  # a space: never equal to a piece of text
                ids = self.memo.get(key)
                if ids is None:
                    ids = self.memo[key] = self.fragment(part, last)
                out.append(ids)
        return b"".join(out)

    def shown(self, piece: bytes) -> str:
        return codecs.charmap_decode(piece, "strict", self.written)[0]

    def learn(self, piece: bytes) -> bytes:
        if piece[:1] == RUN:
            return self.run(piece[1:])
        last = piece[-1:] != INNER
        return self.fragment(self.shown(piece if last else piece[:-1]), last)

    def joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return joined(texts, b"\n")

    # ---- texts -------------------------------------------------------------------------------------
    def pieces(self, buf: np.ndarray, stops: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The buffer cut into fragments and library runs, and how many separators were written up to
        the bytes at ``stops``. White space separates; so do class changes and the forced cuts, marked INNER."""
        kind, low, risk = _CLASS[buf], _FOLD[buf], _RISKY[buf]
        lead = np.flatnonzero(buf[:-1] >= 0xC3)
        fold = _PAIR_FOLD[(buf[lead].astype(np.uint16) << 8) | buf[lead + 1]]
        lead, fold = lead[fold > 0], fold[fold > 0]
        for k, part in ((0, fold >> 8), (1, fold & 255)):
            kind[lead + k], low[lead + k], risk[lead + k] = _LETTER, part, False
        run_of = np.cumsum(kind == _SPACE, dtype=np.int32)
        risky = np.zeros(int(run_of[-1]) + 1, bool)
        risky[run_of[risk]] = True
        keep = risky[run_of] & (kind != _SPACE)
        ka, kb = kind[:-1], kind[1:]
        free = ~keep[:-1] & (ka != _SPACE) & (kb != _SPACE)
        ends = free & ((ka != kb) | (ka == _DIGIT))
        inner = free & ~ends & ~self.inside[low[:-1], low[1:]]
        begins = keep & np.concatenate([[True], ka == _SPACE])
        width = begins.astype(np.int32) + 1
        width[:-1] += ends
        width[:-1] += 2 * inner
        at = np.cumsum(width, dtype=np.int32) - width
        out = np.full(int(at[-1]) + int(width[-1]), 32, np.uint8)
        out[at + begins] = np.where(keep, buf, low)  # the library folds its runs itself
        out[at[begins]] = RUN[0]
        out[at[:-1][inner] + 1] = INNER[0]
        seps = np.cumsum(out == 32, dtype=np.int32)
        return out.tobytes().split(b" "), seps[at[stops] + width[stops] - 1]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as bytes of 16- or 32-bit numbers."""
        if len(self.memo) > HELD // 2:
            self.memo.before = {}
            self.memo = Memo(self.learn, self.memo)
        whole = self.special_of(texts)
        plain = [t for i, t in enumerate(texts) if i not in whole]
        buf, offs = self.joined(plain)
        done = []
        if len(buf):
            found, seps = self.pieces(buf, offs[1:] - 1)
            ids = list(map(self.memo.__getitem__, found))
            bounds = [0, *seps.tolist()]
            done = [b"".join(ids[x:y]) for x, y in zip(bounds, bounds[1:])]
        rest = iter(done)
        return [array(self.code, self.tok.encode(t.decode(), add_special_tokens=False).ids).tobytes() if i in whole
                else next(rest) for i, t in enumerate(texts)]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens' names, joined by a space."""
        return " ".join(map(self.names.__getitem__, ids))


EDGE, CUT, WHOLE = b"\x01", b"\x02", b"\x03"
_WIDE_SPACE = rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"


class SpacedBpe(ForcedBpe):
    """Byte-level vocabularies without a word-end mark, whose words begin with the space before them. Of
    several white-space characters the last stands apart (a space goes to the word behind it); digits
    stay together. EDGE, CUT and WHOLE mark text ends, cuts and runs for the library here. Texts where
    white space beyond ASCII touches other white space are encoded by the library as they are."""

    word_ends = False

    def own_way(self) -> tuple[list[bytes], list[bytes]]:
        marks = [EDGE, CUT, WHOLE]
        return ([*marks, b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"],
                [*marks, rb"[\t-\r ]" + _WIDE_SPACE, _WIDE_SPACE + rb"[\t-\r ]"])

    def learn(self, piece: bytes) -> bytes:
        if piece == EDGE:
            return b""
        return self.run(piece[1:]) if piece[:1] == WHOLE else self.fragment(self.shown(piece), True)

    def run(self, piece: bytes) -> bytes:
        return b"".join(self.fragment(part, True) for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(piece.decode())
                        for part in self.forced(word))

    def pieces(self, buf: np.ndarray, stops: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        kind = np.frombuffer(bytearray(buf.tobytes().translate(_CLASS_OF)), np.int8)
        risk = (buf >= 128) | (buf == ord("'"))
        lead = np.flatnonzero(buf[:-1] >= 0xC3)
        lead = lead[_PAIR_FOLD[(buf[lead].astype(np.uint16) << 8) | buf[lead + 1]] > 0]
        for k in (0, 1):
            kind[lead + k], risk[lead + k] = _LETTER, False
        edge, space = buf == EDGE[0], kind == _SPACE
        whole = np.zeros(len(buf), bool)
        if risk.any():
            run_of = np.cumsum(space | edge, dtype=np.int32)
            risky = np.zeros(int(run_of[-1]) + 1, bool)
            risky[run_of[risk]] = True
            whole = risky[run_of] & ~edge
        a, b = slice(None, -1), slice(1, None)
        # cut[i]: between byte i and byte i + 1
        cut = edge[a] | edge[b]
        inside = ~space[a] & ~space[b]
        together = self.inside.ravel()[(buf[a].astype(np.uint16) << 8) | buf[b]]
        cut |= inside & ~whole[b] & ((kind[a] != kind[b]) | ~together)
        cut |= ~space[a] & space[b]
        cut |= space[a] & ~space[b] & (buf[a] != 32)
        last = np.append(~space[b] & ~edge[b], False)      # of its white space, and something follows
        cut |= space[a] & space[b] & last[b]
        cuts = np.flatnonzero(cut)
        # written before the byte at each place: a cut, then the mark of a run that begins there
        at, mark = cuts + 1, np.full(len(cuts), CUT[0], np.uint8)
        if whole.any():
            begins = np.append(True, cut) & whole & (~space | np.append(last[:-1] & (buf[a] == 32), False))
            at = np.append(at, np.flatnonzero(begins))
            order = np.argsort(at, kind="stable")
            mark = np.append(mark, np.full(len(at) - len(mark), WHOLE[0], np.uint8))[order]
            at = at[order]
        at += np.arange(len(at))
        out = np.empty(len(buf) + len(at), np.uint8)
        text = np.ones(len(out), bool)
        text[at] = False
        out[text] = buf
        out[at] = mark
        return out.tobytes().split(CUT), np.searchsorted(cuts, stops)

    def joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return joined(texts, EDGE)


_held: dict[str, ForcedBpe] = {}


def coder(path: str, kind: type[ForcedBpe] = ForcedBpe) -> ForcedBpe:
    """This worker's coder for a vocabulary file; the file is there on every machine."""
    if path not in _held:
        _held[path] = kind(path)
    return _held[path]


def vocabulary(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _placed(df: DataFrame, out: StructField, work) -> DataFrame:
    """Append (or replace) a column that ``work(table)`` makes from batches of bounded text."""
    others = [c for c in df.columns if c != out.name]
    schema = StructType([df.schema[c] for c in others] + [out])

    def task(batches):
        for batch in batches:
            for part, column in work(batch):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], column], [*others, out.name])

    return df.mapInArrow(task, schema)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array<int>): the token ids of each whole text."""
    at = docs.columns.index(text_col)
    docs = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))

    def work(batch):
        bpe = coder(path)
        texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
        for a, b in chunks([len(t) + 64 for t in texts], CHUNK):
            raw = bpe.encode(texts[a:b])
            flat = np.frombuffer(b"".join(raw), bpe.code).astype(np.int32)
            ends = np.cumsum([0] + [len(r) // np.dtype(bpe.code).itemsize for r in raw]).astype(np.int32)
            yield batch.slice(a, b - a), pa.ListArray.from_arrays(ends, flat)

    return _placed(docs, StructField(ids_col, ArrayType(IntegerType())), work)


def decode(frame: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``frame`` with ``out_col``: the text of the ids; null ids decode to the empty string."""
    at = frame.columns.index(ids_col)

    def work(batch):
        bpe = coder(path)
        ids = batch.column(at)
        sizes = [n or 0 for n in pa.compute.list_value_length(ids).to_pylist()]
        for a, b in chunks([n * 6 + 64 for n in sizes], 2 * CHUNK):
            texts = [bpe.decode(v or []) for v in ids.slice(a, b - a).to_pylist()]
            yield batch.slice(a, b - a), pa.array(texts, pa.string())

    return _placed(frame, StructField(out_col, StringType()), work)


def op13_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path).select("doc_id", "ids")
    both = decode(coded, path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

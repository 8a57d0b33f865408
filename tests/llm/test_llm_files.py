import random
import zlib

import numpy as np
import pytest

from kestrel.llm import packing as P
from kestrel.llm import rans as R
from kestrel.llm.forced_bpe import ForcedBpe, SpacedBpe, coder, vocabulary

SCHEMA = "doc_id long, text string, ids string"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    bits = ["the", "fox", "Ünï", "naïve", " ", "  ", "\n", "\n\n", "\t", "it's", "'", "...", "42", "漢字", "é", "İx",
            "<|endoftext|>", "_", " ", "\x1c", "🙂", "word###", "A.B", " . "]
    texts = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(0, 60))) for _ in range(n)]
    texts += ["", None, " ", "\n", "long " * 9000, "x" * 5000]
    r.shuffle(texts)
    rows = [(i * 3, t, "c") for i, t in enumerate(texts)]
    return rows + [rows[0], (rows[1][0], "the same id", None), (None, "no id", None)]


def encoder(name):
    return coder(vocabulary(name), SpacedBpe if name == R.BYTE_BPE else ForcedBpe)


def ids_of(text, name, end):
    e = encoder(name)
    return np.array([*e.tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", [R.BYTE_BPE, P.WORD_BPE])
def test_word_by_word_ids_equal_the_library(name):
    e = encoder(name)
    texts = [t or "" for s in range(6) for _, t, _ in corpus(s, 300)]
    for text, raw in zip(texts, e.encode([t.encode() for t in texts])):
        assert np.frombuffer(raw, e.code).tolist() == e.tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_tokens_round_trip_through_files(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_IDS", 1500)
    rows = corpus()
    blocks, table = R.write_tokens(spark.createDataFrame(rows, SCHEMA))
    assert blocks.count() > 5
    got = [(r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in R.read_tokens(blocks, table).collect()]
    got.sort()
    assert [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()
    keys = [g[1] if g[1] is not None else 1 << 62 for g in got]
    assert keys == sorted(keys)
    want = sorted((d if d is not None else 1 << 62, ids_of(t, R.BYTE_BPE, R.END_ID).tobytes()) for d, t, _ in rows)
    assert sorted((k, g[4]) for k, g in zip(keys, got)) == want
    assert all(g[3] == zlib.crc32(g[4]) and g[2] == len(g[4]) // 4 for g in got)


def test_blocks_of_any_size_and_damage():
    r = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 70_000, 200_000):
        ids = np.minimum(r.geometric(0.02, n), 9_000).astype(np.uint16)
        t = R.Table(R.frequencies(np.bincount(ids, minlength=3)))
        payload = t.block(np.arange(2), np.array([n, 0]), ids)
        assert (t.read(payload)[2] == ids).all()
        if n > 1000:
            p = np.bincount(ids) / n
            entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * n / 8
            assert len(payload) < 1.15 * entropy + 5000
            for at in (3, 60, len(payload) // 2, len(payload) - 1):
                bad = bytearray(payload)
                bad[at] ^= 1
                with pytest.raises(ValueError):
                    t.read(bytes(bad))
            with pytest.raises(ValueError):
                R.Table(R.frequencies(np.ones(9_001, int))).read(payload)


def test_frequencies_sum_up():
    for counts in ([1], [5, 0, 3], [10**12, 1, 1, 0], [1] * 50_000, list(range(60_000))):
        f = R.frequencies(np.array(counts)).astype(int)
        assert f.sum() == 1 << R.SCALE and ((f > 0) == (np.array(counts) > 0)).all()


def check_packing(rows, got):
    want = {}
    for d, t, _ in rows:
        ids = ids_of(t, P.WORD_BPE, P.END_ID)
        for k, a in enumerate(range(0, len(ids), P.CAPACITY)):
            part = ids[a : a + P.CAPACITY]
            key = (d, k, a, len(part), zlib.crc32(part.tobytes()))
            want[key] = want.get(key, 0) + 1
    have, seqs = {}, {}
    for r in got:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        have[key] = have.get(key, 0) + 1
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert have == want
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= P.CAPACITY
    return len(seqs), sum(n for s in seqs.values() for _, n in s)


def test_packing_is_whole_and_tight(spark, monkeypatch):
    rows = corpus()
    n, total = check_packing(rows, P.pack(spark.createDataFrame(rows, SCHEMA)).collect())
    assert n <= total / P.CAPACITY + 2
    monkeypatch.setattr(P, "GROUP", 20)
    check_packing(rows, P.pack(spark.createDataFrame(rows, SCHEMA)).collect())


def test_placement_takes_the_least_sum_of_squares():
    r = random.Random(4)
    lengths = [r.randint(1, 40) for _ in range(300)]
    seqs, offsets = P.place(lengths, 40)
    fill: dict = {}
    for n, s, o in zip(lengths, seqs, offsets):
        def total(levels):
            counts: dict = {}
            for v in levels.values():
                if v < 40:
                    counts[v] = counts.get(v, 0) + 1
            return sum(c * c for c in counts.values())
        # a new sequence only where the piece fits onto none
        choices = [total({**fill, k: v + n}) for k, v in fill.items() if v + n <= 40] or [total({**fill, "new": n})]
        assert fill.get(s, 0) == o
        fill[s] = o + n
        assert total(fill) == min(choices)


def test_placement_needs_hardly_more_sequences_than_best_fit():
    r = random.Random(6)
    for low, high in ((700, 2100), (900, 2100), (1, 4096), (30, 700)):
        lengths = sorted((r.randint(low, high) for _ in range(4000)), reverse=True)
        room: list[int] = []
        for n in lengths:
            fits = [(v, i) for i, v in enumerate(room) if v >= n]
            if fits:
                room[min(fits)[1]] -= n
            else:
                room.append(P.CAPACITY - n)
        seqs, _ = P.place(lengths)
        assert max(seqs) + 1 <= len(room) * 1.005 + 1


def test_repeated_rows_are_dealt_to_many_groups(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 50)
    rows = [(7, "the same text " * 20, "")] * 400 + [(None, "no id", "")] * 400
    got = P.pack(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == 800
    sizes = {}
    for x in got:
        sizes[x["sequence_id"] >> 40] = sizes.get(x["sequence_id"] >> 40, 0) + 1
    assert max(sizes.values()) < 150


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.pack(none).count() == 0
    assert R.read_tokens(*R.write_tokens(none)).count() == 0


@pytest.mark.parametrize("name", [R.BYTE_BPE, P.WORD_BPE])
def test_ids_are_those_of_the_vocabulary_as_loaded(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh, e = Tokenizer.from_file(public_tokenizers.path(name)), encoder(name)
    texts = ["one <|endoftext|> two", "a<|endoftext|>b c", "<|startoftext|>", "x <|startoftext|> <|endoftext|>",
             "one <|ENDOFTEXT|> two", "<|endoftext|", "no token", "", " \n<|endoftext|>\n y"]
    texts += [t or "" for s in range(4) for _, t, _ in corpus(s, 100)]
    for text, raw in zip(texts, e.encode([t.encode() for t in texts])):
        assert np.frombuffer(raw, e.code).tolist() == fresh.encode(text, add_special_tokens=False).ids, repr(text)

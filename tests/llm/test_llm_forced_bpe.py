import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from kestrel.llm import forced_bpe as B

BITS = ["the", "Fox", "Ünï", "naïve", " ", "  ", "\n", "\t", "it's", "'", "'S", "...", "42", "漢字", "é", "é", "İx",
        "<|endoftext|>", "_", "\x1c", "\x01", "\x02", "🙂", "word###", "A.B", "qzx", "xqj", "\xa0", "　", "ΑΣ", "ſ", "K",
        "​", "٣", "½", "don't", "''s", "\x85", "﻿", "×", "÷", "ÿŸ", "Ѐё"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(B.vocabulary())


def texts(seed, n):
    r = random.Random(seed)
    some = ["".join(r.choice(BITS) + r.choice(["", "", " "]) for _ in range(r.randint(0, 40))) for _ in range(n)]
    some += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x2000)])) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return some + ["".join(chr(r.randrange(33, 127)) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_ids_and_names_equal_the_library(library):
    bpe = B.ForcedBpe(B.vocabulary())
    some = texts(1, 1500)
    for text, raw in zip(some, bpe.encode([t.encode() for t in some])):
        ids = np.frombuffer(raw, bpe.code).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_words_with_their_spaces_equal_the_library():
    from tokenizers import Tokenizer

    fresh, bpe = Tokenizer.from_file(B.vocabulary("byte_bpe_50k.json")), B.SpacedBpe(B.vocabulary("byte_bpe_50k.json"))
    r = random.Random(8)
    more = ["\n\n", " \n", "\r\n", "10000", "ÿ9", "\x03", "  "]
    some = texts(2, 1500) + ["".join(r.choice(BITS + more) + r.choice(["", "", " "]) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    some += ["".join(chr(r.choice([r.randrange(9, 14), 32, r.randrange(33, 127)])) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    for text, raw in zip(some, bpe.encode([t.encode() for t in some])):
        assert np.frombuffer(raw, bpe.code).tolist() == fresh.encode(text, add_special_tokens=False).ids, repr(text)


def test_no_token_holds_a_forced_pair():
    bpe = B.ForcedBpe(B.vocabulary())
    added = {t.content for t in bpe.tok.get_added_tokens_decoder().values()}
    pairs = {(a, b) for t in bpe.tok.get_vocab() if t not in added
             for t in [t.removesuffix("</w>")] if all(c in bpe.bytes_of for c in t)
             for a, b in zip([bpe.bytes_of[c] for c in t], [bpe.bytes_of[c] for c in t][1:])}
    assert pairs == set(zip(*map(list, np.nonzero(bpe.inside))))
    # a word with a forced pair is put together from independent fragments
    word = next(a + b for a in "qxjz" for b in "qxjzk" if not bpe.inside[ord(a), ord(b)])
    assert bpe.forced("ab" + word + "in") == ["ab" + word[0], word[1] + "in"]


def test_memo_may_be_dropped_any_time(library, monkeypatch):
    monkeypatch.setattr(B, "HELD", 10)
    bpe = B.ForcedBpe(B.vocabulary())
    for s in range(5):
        some = texts(s, 50)
        assert [np.frombuffer(r, bpe.code).tolist() for r in bpe.encode([t.encode() for t in some])] == [
            library.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("kind, name", [(B.ForcedBpe, B.WORD_BPE), (B.SpacedBpe, "byte_bpe_50k.json")])
def test_fragments_met_again_are_learned_once(monkeypatch, kind, name):
    monkeypatch.setattr(B, "HELD", 400)
    bpe, learned, fragment = kind(B.vocabulary(name)), Counter(), kind.fragment
    monkeypatch.setattr(bpe, "fragment", lambda piece, last: learned.update([piece]) or fragment(bpe, piece, last))
    r = random.Random(2)
    for _ in range(30):
        new = ["".join(r.choices("abcdefghijklmnopqrst", k=9)) for _ in range(60)]
        bpe.encode([" ".join(["x harbour", *new, "lantern"]).encode()])
    assert len(bpe.memo) + len(getattr(bpe.memo, "before", ())) < 2000
    assert {n for p, n in learned.items() if "harbour" in p or "lantern" in p} == {1}


def test_frames(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts(9, 60))]
    rows += [(7, None, None), (None, "no id", "x"), rows[0], (8, "", "x"), (9, "long " * 200_000, "x"), (10, "x" * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string").repartition(3)
    got = B.decode(B.encode(docs, B.vocabulary()), B.vocabulary()).collect()
    assert [f for f in got[0].asDict()] == ["doc_id", "text", "ids", "decoded"]
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted((str(d), t or "") for d, t, _ in rows)
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    empty = B.encode(docs.limit(0), B.vocabulary())
    assert empty.count() == 0


def test_query_digests(spark, library, tmp_path):
    some = texts(4, 20) + [None, ""]
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in B.op13_forced_bpe(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(some):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from hopline.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(bpe.read_ranks(None, PATH))


@pytest.fixture(scope="module")
def reference(vocab):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def test_every_script_and_odd_pieces(vocab, reference):
    rng = random.Random(1)
    texts = ["", " ", "a" * 3000, "ab" * 2000, " " * 999 + "x", "\x1c\x1d \x85\xa0x", "日本語テキスト" * 40, "😀👍🏽" * 30, "\n\n  x", "it's we'LL"]
    texts += ["".join(chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3000, 256)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), 32])) for _ in range(100)) for _ in range(300)]
    got = [x for part in bpe.Encoder(vocab, P.PATTERN).encode(texts) for x in part]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [reference.encode_ordinary(t) for t in texts]
    assert [bpe.Decoder(vocab).decode(g) for g in got] == [t.encode() for t in texts]


def test_both_trees_merge_alike(vocab):
    rng = random.Random(2)
    pieces = [bytes(rng.randrange(97, 103) for _ in range(rng.randrange(2, 60))) for _ in range(300)]
    together = bpe.merge_together(pieces, 64, vocab)
    assert together == [bpe.merge_alone(p, vocab) for p in pieces]


def test_a_small_memory_changes_nothing(vocab, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PART_CHARS", 20)
    texts = ["some words and other words", "more words", "", "some words again and again"] * 3
    small = [x for part in bpe.Encoder(vocab, P.PATTERN).encode(texts) for x in part]
    monkeypatch.undo()
    assert small == [x for part in bpe.Encoder(vocab, P.PATTERN).encode(texts) for x in part]


def test_documents(spark, odd_docs, reference):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(odd_docs, PATH, P.PATTERN).collect()}
    want = set()
    for r in odd_docs.select("doc_id", "text").collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == want
    assert bpe.digests(odd_docs.limit(0), PATH, P.PATTERN).count() == 0

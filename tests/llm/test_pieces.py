import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from hopline.llm import pieces as S
from hopline.llm.queries import PIECES

PATH = public_tokenizers.path(PIECES)


@pytest.fixture(scope="module")
def vocab():
    return S.Vocabulary(S.read_model(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(vocab, texts):
    return [list(ids) for part in S.Encoder(vocab).encode(texts) for ids in part]


def test_same_ids_as_the_library(vocab, library):
    rng = random.Random(1)
    pieces = [p for p, _, kind in S.read_model(PATH)["pieces"] if kind == S.NORMAL]
    bits = ["a", "b", "é", " ", "  ", "▁", "日", "本", "1", "\n", "\t", "😀", "Ａ", "\x00", "the ", "ing", "xx", "===", "́", "한", "ب", " " * 7, " " * 40]
    texts = ["", " ", "▁", " " * 100, "<s> </s> <0x41> <unk>", "x" * 5000, "ab" * 3000, "日本語" * 500, " " * 3000 + "x"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 120))) for _ in range(1500)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 50))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x3000)])) for _ in range(80)) for _ in range(300)]
    got = ids_of(vocab, texts)
    assert got == library.encode(texts, num_threads=1)
    decoder = S.Decoder(vocab)
    assert [decoder.decode(ids) for ids in got] == library.decode(got)


def test_decodes_any_ids_as_the_library(vocab, library):
    rng = random.Random(2)
    ids = [[rng.randrange(0, 32_000 if rng.random() < .5 else 300) for _ in range(rng.randrange(0, 12))] for _ in range(10_000)]
    decoder = S.Decoder(vocab)
    assert [decoder.decode(i) for i in ids] == [library.decode(i) if i else "" for i in ids]


def tiny(scored):
    """A vocabulary of given pieces and scores, and the plain queue over the whole text as its model."""
    pieces = [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, s, 1) for p, s in scored)]
    return S.Vocabulary({"pieces": pieces, "prefix": False, "unknown": "?"})


def plain(text, scored):
    score, parts = dict(scored), list(text)
    while True:
        found = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
        if not found:
            return parts
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_rounds_equal_one_merge_at_a_time():
    """Vocabularies where a merge makes better pairs, equal scores, pieces that no merge reaches, characters that are no pieces."""
    rng = random.Random(3)
    for trial in range(150):
        letters = "abc"[:rng.choice([1, 2, 3])]
        strings = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(2, 25))}
        scored = [(p, float(rng.randrange(4 if trial % 2 else 40))) for p in sorted(strings)]
        vocab = tiny(scored)
        texts = ["".join(rng.choice(letters + "d") for _ in range(rng.choice([1, 2, 5, 20, 80, 200]))) for _ in range(25)]
        place = {p: 257 + i for i, (p, _) in enumerate(scored)}
        want = [[i for s in plain(t, scored) for i in ([place[s]] if s in place else [1 + b for b in s.encode()])] for t in texts]
        assert ids_of(vocab, texts) == want


def test_query_on_odd_documents(spark, odd_docs, docs, library):
    for rows in (odd_docs, docs):
        got = sorted((str(r[0]), *tuple(r)[1:]) for r in S.digests(rows, PATH).collect())
        want = []
        for r in rows.select("doc_id", "text").collect():
            ids = library.encode(r["text"] or "")
            want.append((str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((library.decode(ids) if ids else "").encode()).hexdigest()))
        assert got == sorted(want)
    kept = S.round_trip(odd_docs, PATH, out_col="size2")
    assert kept.columns == [*odd_docs.columns, "size2"] and kept.count() == odd_docs.count()
    assert S.digests(odd_docs.limit(0), PATH).count() == 0


def test_memory_is_bounded(vocab, library, monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 20), monkeypatch.setattr(S, "PART_CHARS", 50)
    texts = [f"word{i % 97} again{i}" for i in range(400)] * 2
    encoder = S.Encoder(vocab)
    assert [list(ids) for part in encoder.encode(texts) for ids in part] == library.encode(texts)
    assert len(encoder.memory["young"]) + len(encoder.memory["old"]) < 100


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as files

    model = files.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        S.read_model(str(tmp_path / "m.model"))

import hashlib
import re

import numpy as np
import xxhash

from hopline.llm import syncmers as S


def chain(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), seed)
    return int(np.uint64(seed).view(np.int64))


def cut(text):
    """Words of up to 8 code points, and the 8 at each place of longer runs."""
    runs = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [run[i:i + 8] for run in runs for i in range(max(1, len(run) - 7))]


def anchors(text):
    units = [chain(u) for u in cut(text)]
    inner = [chain(a, b) for a, b in zip(units, units[1:])]
    out = []
    for i in range(len(units) - S.K + 1):
        window = inner[i:i + 4]
        if min(window[0], window[3]) <= min(window[1], window[2]):
            out.append((i, chain(chain(window[0], window[2]), window[3])))
    if not out:
        out = [(0, chain(",".join(map(str, units))) if units else 0)]
    return out


def printed(found):
    """128 bits over places (4 bytes) and hashes (8 bytes), each value seeded with the hash of those before it."""
    out = ""
    for seed in (42, xxhash.xxh64_intdigest((7919).to_bytes(4, "little"), 42)):
        for at, value in found:
            seed = xxhash.xxh64_intdigest(at.to_bytes(4, "little"), seed)
            seed = xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), seed)
        out += f"{seed:016x}"
    return out


def jaccard(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b)


def check(docs, monkeypatch, rows=7):
    monkeypatch.setattr(S, "ROWS", rows)
    own = docs.select("doc_id", "text").collect()
    ids = [r["doc_id"] for r in own]
    got = S.compare_edited(docs).collect()
    assert len(got) == len(own)
    if len(set(ids)) == len(ids):
        order = sorted(own, key=lambda r: -r["doc_id"])
        by_id = {r["doc_id"]: r for r in got}
        for r, following in zip(order, order[1:] + order[:1], strict=True):
            text, after = r["text"] or "", following["text"] or ""
            third = len(text) // 3
            edited = text[:len(text) - third] + after[:third]
            g = by_id[r["doc_id"]]
            assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert (g["fingerprint"], g["edited_fingerprint"]) == (printed(anchors(text)), printed(anchors(edited)))
            assert g["near_edited"] == jaccard(anchors(text), anchors(edited))
            assert g["near_next"] == jaccard(anchors(text), anchors(after))
    prints = {}
    for r in own:
        prints.setdefault(r["doc_id"], set()).add(tuple(anchors(r["text"] or "")))
    for g in got:
        assert len(g["fingerprint"]) == len(g["edited_fingerprint"]) == 32
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
    return got


def test_documents_in_one_range_and_many(docs, monkeypatch):
    few = check(docs, monkeypatch, 10**6)
    many = check(docs, monkeypatch, 7)
    assert sorted(map(str, few)) == sorted(map(str, many))
    assert np.mean([g["near_edited"] for g in few]) > 0.4 > 0.1 > np.mean([g["near_next"] for g in few])


def test_odd_documents(odd_docs, monkeypatch):
    got = check(odd_docs, monkeypatch, 2)
    same = {}
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    for g in got:
        if g["doc_id"] in (1, 3, 4, 6):
            same.setdefault(bool(next(iter(texts[g["doc_id"]])).split()), set()).add(g["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert S.compare_edited(odd_docs.limit(0)).count() == 0


def test_one_document_is_its_own_next(spark, monkeypatch):
    frame = spark.createDataFrame([(5, "a b c d e f")], "doc_id bigint, text string")
    got = check(frame, monkeypatch)
    assert got[0]["near_next"] == 1.0


def test_outlying_ids(spark, monkeypatch):
    rows = [(i * i * i - 10**15 * (i % 7 == 0), f"text number {i} with words " * (i % 5 + 1)) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), monkeypatch, 3)


def test_anchors_do_not_depend_on_distant_text(spark):
    words = [f"w{i}" for i in range(60)]
    frame = spark.createDataFrame([(" ".join(words),), (" ".join(["other"] * 7 + words),)], "text string")
    a, b = (r["a"] for r in S.with_anchors(frame, "text", "a").collect())
    assert {(x["at"] + 7, x["hash"]) for x in a} <= {(x["at"], x["hash"]) for x in b}


def test_runs_without_spaces(spark):
    """An inserted character changes the anchors around it only, also outside the basic plane; units never split a pair."""
    rng = np.random.default_rng(5)
    for low, high in ((0x4E00, 0x9F00), (0x20000, 0x2A000), (0x61, 0x7B)):
        run = "".join(map(chr, rng.integers(low, high, 600)))
        texts = [run, chr(low) + run, run[:300] + chr(low + 1) + run[300:], "x " + run, run[:7], run[:8], run[:9], run[:12] + " " + run[:3]]
        frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        found = {r["i"]: [tuple(x) for x in r["a"]] for r in S.with_anchors(frame, "text", "a").collect()}
        for i, text in enumerate(texts):
            assert found[i] == anchors(text), (low, i)
        assert all(jaccard(found[0], found[i]) > 0.9 for i in (1, 2, 3))

import random

import numpy as np
import xxhash

from hopline.llm import simhash
from tests.llm.conftest import prose


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    names = sorted(root)
    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {p: find(p) for p in names}


def check(docs, **options):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r["text"]) for r in rows]
    root = brute_components(set(prints))
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r["doc_id"] is not None:
            least[root[p]] = min(least.get(root[p], r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], p, least.get(root[p])) for r, p in zip(rows, prints, strict=True)), key=str)
    found = simhash.near_duplicates(docs, **options)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found.collect()), key=str)
    assert got == want


def test_documents_against_all_pairs(docs):
    check(docs)


def test_odd_documents(odd_docs):
    check(odd_docs)
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_hot_groups_are_split_in_chunks(spark):
    """Fingerprints in a dense ball: chunks of 16 give the same components as one tree."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9))) for _ in range(400)}
    prints |= {rng.getrandbits(64) for _ in range(50)}
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp bigint")
    want = brute_components(prints)
    for chunk in (16, 4096):
        edges = simhash.linked(frame, 4, chunk)
        assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 4 for r in edges.collect())
        got = {r["node"] % (1 << 64): r["root"] for r in simhash.components(edges).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(got.get(p, p), set()).add(p)
        wanted = {}
        for p in prints:
            wanted.setdefault(want[p], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_one_of_each_group_stays(spark, odd_docs, docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    texts = [r["text"] for r in kept.collect()]
    roots = brute_components({brute_print(r["text"]) for r in odd_docs.collect()})
    assert sorted(roots[brute_print(t)] for t in texts) == sorted(set(roots.values()))
    found = simhash.near_duplicates(docs)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(
        r["component_id"] for r in found.select("component_id").distinct().collect())


def test_words_are_ascii_words():
    rng = random.Random(4)
    for text in (prose(rng, 30), "A\u00a0B c\x1cd É é", "\x0b a \x0c b c d e"):
        assert int(simhash.fingerprints([text], 4)[0]) == brute_print(text)

"""What a task of the divergence audit holds does not grow with the rows that it gets, nor with those of one batch."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from hopline.llm import divergence as D
from tests.llm.test_divergence import corrections, patterns

ITEM = pa.struct([("code", pa.int32()), ("count", pa.int64()), ("p", pa.int64()), ("p0", pa.int64())])


def test_a_tree_is_bounded_in_a_large_batch(monkeypatch):
    rng = random.Random(6)
    rows = patterns(rng, 1500, 5)
    p = {(s, c): 10 ** 8 * (s + 1) + c for s in range(5) for c in range(1, 4)}
    p0 = {s: 17 + s for s in range(5)}
    listed = [[{"code": s, "count": c, "p": p[s, c], "p0": p0[s]} for s, c in r] for r, _ in rows]
    table = pa.table({"lang": ["en"] * len(rows) + ["fr"] * len(rows), "row": pa.array(listed * 2, pa.list_(ITEM)), "times": [m for _, m in rows] * 2})
    sizes = []

    class Seen(D.PatternTree):
        def __init__(self, offsets, *fields):
            sizes.append(int(offsets[-1]))
            super().__init__(offsets, *fields)

    monkeypatch.setattr(D, "PatternTree", Seen)
    monkeypatch.setattr(D, "TREE_ITEMS", 40)
    got = Counter()
    for batch in D.tree_corrections(iter([pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], table.schema.names)])):
        for lang, a, b, h, w in zip(*(c.to_pylist() for c in batch.columns)):
            got[lang, a, b] += h * 2 ** 31 + w
    assert got == Counter({(lang, a, b): v for lang in ("en", "fr") for (a, b), v in corrections(rows, p, p0).items()})
    assert max(sizes) < 40 + 5 and sum(sizes) == 2 * sum(len(r) for r, _ in rows)


def test_memory_of_many_rows():
    rng = np.random.default_rng(1)
    size = rng.integers(2, 9, 200_000)
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    count = rng.integers(1, 50, offsets[-1])
    code = (np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(code), pa.array(count), pa.array(count * 1000 + 7), pa.array(code.astype(np.int64) + 17)], fields=list(ITEM))
    batches = pa.table({"lang": ["en"] * len(size), "row": pa.ListArray.from_arrays(pa.array(offsets), items), "times": size}).to_batches(10_000)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in D.tree_corrections(iter(batches)))
        assert tracemalloc.get_traced_memory()[1] < 120e6  # about 330 MB if all of them were one tree
    finally:
        tracemalloc.stop()

import hashlib
import math
import random

import numpy as np
import pytest

from hopline.llm import clustering as C

SCHEMA = "vec_id bigint, embedding array<float>, label int, distance string, id int, v int"


def brute(rows, clusters=40, rounds=5, dims=64, scale=256, salt="2:"):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(float(np.float32(c)) * scale) for c in x]))
    start = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    at = [v for _, v in start[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(at))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(at)):
            mine = [v for (_, v), c in zip(kept, own) if c == k]
            if mine:
                at[k] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in kept]
    spread = {k: sum(d for _, d, c in found if c == k) for k in range(len(at))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted((i, k, d, spread[k], sum(spread.values()), digest[k]) for i, d, k in found)


def told(frame, **options):
    return sorted(map(tuple, C.cluster(frame, **options).collect()))


def test_against_brute_force(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, .1) for c in rng.choice(centres)]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 520)]  # a hot group of copies
    rows += [rows[3], rows[3], (7, rows[9][1]), (-5, [0.0] * 64), (-6, [-0.001] * 64)]  # repeated rows, one id twice
    rows += [(600, None), (601, []), (602, [1.0] * 63), (603, [1.0] * 65), (604, [1.0] * 63 + [None]), (605, [1.0] * 63 + [float("nan")]),
             (606, [1.0] * 63 + [float("-inf")])]
    frame = spark.createDataFrame([(i, x, 1, "d", 2, 3) for i, x in rows], SCHEMA).repartition(5)
    seen = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    assert told(frame) == brute(seen)
    assert told(frame, clusters=3, rounds=1, salt="x") == brute(seen, 3, 1, salt="x")


def test_ties_and_few_vectors(spark):
    """Copies of one vector start several centroids: all go to the first, the others stay empty and where they are."""
    rows = [(i, [0.5] * 64) for i in range(5)] + [(9, [0.25] * 64)]
    frame = spark.createDataFrame([(i, x, 1, "d", 2, 3) for i, x in rows], SCHEMA)
    got = told(frame)
    assert got == brute(rows) and len({r[1] for r in got}) == 2 and {r[2] for r in got} == {0}


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, None, 1, "d", 2, 3)], SCHEMA)
    assert told(frame) == [] and told(frame.limit(0)) == [] and C.cluster(frame).columns[0] == "vec_id"


def test_too_large_components_end_the_run(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64, 1, "d", 2, 3)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        told(frame)


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_dictionaries_lose_nothing(block):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-300, 300, (500, 64))
    vectors[200:] = vectors[rng.integers(0, 200, 300)]
    at = rng.integers(-300, 300, (6, 64))
    codes, entries = C.encode_part(vectors, block)
    part = C.Part(codes, entries, at, block)
    back = np.concatenate([own[code] for own, code in zip(part.entries, part.codes)], axis=1)
    assert (back == vectors).all() and all(len(own) <= 200 for own in part.entries)
    exact = ((vectors[:, None] - at) ** 2).sum(axis=2)
    assert (part.distance == exact.min(axis=1)).all() and (part.cluster == exact.argmin(axis=1)).all()
    assert (part.sums(6) == np.stack([vectors[part.cluster == k].sum(axis=0) for k in range(6)])).all()


def test_parts_of_any_size_give_the_same(spark, monkeypatch):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    whole = told(frame)
    assert told(frame, block=5) == whole and told(frame.repartition(7)) == whole
    assert whole == brute([(r["vec_id"], r["embedding"]) for r in frame.collect()])

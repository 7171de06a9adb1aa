import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hopline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, ratio=1.5, most=2.0):
    """Shares by weight; what exceeds a cap is shared again among the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()) * ratio, set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        goal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if goal[s] > most * sizes[s]}
        if not above:
            return {s: goal.get(s, most * sizes[s]) for s in names}
        capped |= above


def check(docs, block, tolerance):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = brute_targets(sizes)
    got = mixing.mix(docs, block=block).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r["doc_id"]), len(WORD.findall(r["text"] or ""))) for r in rows)
    by_goal = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_goal[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert {k[0] for k in by_goal} == set(sizes.values())
    goals = Counter((sizes[s], round(t, 6)) for s, t in want.items())
    assert set(by_goal) == set(goals)
    for key, taken in by_goal.items():
        assert abs(taken - key[1] * goals[key]) <= tolerance * goals[key]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, block=block).collect()))


def test_documents(docs):
    check(docs, 16, 40)


def test_odd_documents(odd_docs):
    check(odd_docs, 8, 20)
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_no_words_at_all(spark):
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(empty).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 63, 64, 65, 1000, 4096, 5001])
def test_permutations_are_bijections(spark, n):
    frame = spark.range(n).withColumn("n", F.lit(n).cast("bigint"))
    got = frame.select(mixing.permuted(F.col("id"), F.col("n"), mixing.binary_size(F.col("n")), F.lit("key")).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))
    if n >= 1000:
        assert [r["p"] for r in got] != sorted(r["p"] for r in got)


def test_large_indexes_do_not_overflow(spark):
    n = (1 << 39) + 12345
    frame = spark.range(5000).select((F.col("id") * 100_000_007 % n).alias("i"), F.lit(n).alias("n"))
    got = frame.select(mixing.permuted(F.col("i"), F.col("n"), mixing.binary_size(F.col("n")), F.lit(1)).alias("p")).collect()
    assert len({r["p"] for r in got}) == 5000 and all(0 <= r["p"] < n for r in got)


def test_shards_draw_all_slots(docs):
    placed = mixing.layout(docs, "doc_id", "text", "source")
    slots = mixing.slots(mixing.targets(placed), 16, shards=4)
    counts = mixing.shard_counts(slots).collect()
    assert sum(r["slots"] for r in counts) == slots.count() and {r["shard"] for r in counts} == {0, 1, 2, 3}
    uses = slots.groupBy("source", "block").count().agg(F.max("count")).first()[0]
    assert uses <= 2


def test_mixed_texts_hold_the_words_taken(docs, odd_docs):
    for frame in (docs, odd_docs):
        taken = Counter()
        for r in mixing.mix(frame, block=16).collect():
            taken[r["doc_id"]] += r["taken"]
        mixed = mixing.mixed_documents(frame, block=16)
        assert mixed.schema == frame.schema
        texts = {r["doc_id"]: set(WORD.findall(r["text"] or "")) for r in frame.collect() if r["doc_id"] is not None}
        words = Counter()
        for r in mixed.collect():
            own = WORD.findall(r["text"])
            words[r["doc_id"]] += len(own)
            assert r["n_chars"] == len(r["text"])
            if r["doc_id"] not in (None, 1, 2):
                assert set(own) <= texts[r["doc_id"]]
        assert +words == +taken
    assert mixing.mixed_documents(odd_docs.limit(0)).count() == 0

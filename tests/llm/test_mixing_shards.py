"""The shard draw decides where each block goes, and rows of one id are laid out by many tasks."""
from collections import Counter

from pyspark.sql import functions as F

from hopline.llm import mixing


def test_shards_hold_the_words_taken(docs, odd_docs):
    for frame in (docs, odd_docs):
        got = mixing.mix(frame, block=16).collect()
        assert all(sum(s["words"] for s in r["shards"]) == r["taken"] for r in got)
        assert all([s["shard"] for s in r["shards"]] == sorted({s["shard"] for s in r["shards"]}) for r in got)
        placed = mixing.layout(frame, "doc_id", "text", "source")
        slots = mixing.slots(mixing.targets(placed), 16)
        parts = mixing.drawn_parts(placed, slots, 16).drop("times", "shards")
        drawn = parts.join(slots.withColumnRenamed("source", "s").withColumnRenamed("block", "b"),
                           F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        want = {r["shard"]: r["n"] for r in drawn.groupBy("shard").agg(F.sum("words").alias("n")).collect()}
        by_shard = Counter()
        for r in got:
            by_shard.update({s["shard"]: s["words"] for s in r["shards"]})
        assert by_shard == want and len(want) > 1


def test_another_seed_moves_the_blocks(docs):
    one, two = ({r["doc_id"]: r["shards"] for r in mixing.mix(docs, block=16, seed=seed).collect()} for seed in (0, 1))
    assert one.keys() == two.keys() and one != two

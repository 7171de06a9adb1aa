"""Each shard holds a fixed number of blocks, its counts by source multinomial; all of them together meet the quotas."""
from collections import Counter

from pyspark.sql import functions as F

from hopline.llm import mixing


def goals_of(spark, sizes):
    rows = [(s, n, float(t)) for s, (n, t) in sizes.items()]
    return spark.createDataFrame(rows, "source string, source_size bigint, target double")


SIZES = {"a": (40_000, 80_000), "b": (90_000, 30_000), "c": (6_400, 9_600), None: (640, 1280), "d": (0, 0), "e": (100_000, 64)}


def test_quotas_shard_sizes_and_blocks(spark):
    got = mixing.slots(goals_of(spark, SIZES), 64, shards=7, seed=3).collect()
    by_source = Counter(r["source"] for r in got)
    assert by_source == {"a": 1250, "b": 469, "c": 150, None: 20, "e": 1}
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    uses = Counter((r["source"], r["block"]) for r in got)
    assert {uses["a", b] for b in range(625)} == {2} and {uses[None, b] for b in range(10)} == {2}
    assert sorted(uses["c", b] for b in range(100)) == [1] * 50 + [2] * 50 and max(uses["b", b] for b in range(1407)) == 1
    slots = [(r["source"], r["slot"]) for r in got]
    assert len(set(slots)) == len(slots)


def test_draws_are_multinomial(spark):
    """Counts of one source over many shards have the mean and the spread of a binomial, and shards do not resemble each other."""
    quota = mixing.quotas(goals_of(spark, {"a": (64_000_000, 25_600_000), "b": (64_000_000, 38_400_000)}))
    total, shards = 1_000_000, 1000
    rows = mixing.shard_draws(quota, total, shards, seed=1).collect()
    one = {r["shard"]: r["drawn"] for r in rows if r["code"] == 1}
    counts = [one[s] for s in range(shards)]
    mean = sum(counts) / shards
    spread = sum((c - mean) ** 2 for c in counts) / shards
    assert abs(mean - 400) < 3 and 200 < spread < 280  # 1000 x .4 x .6 = 240
    beside = sum((a - mean) * (b - mean) for a, b in zip(counts, counts[1:])) / shards
    assert abs(beside) < 30
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["drawn"]
    assert set(sums.values()) == {total // shards}


def test_slots_are_made_by_tasks_in_number(spark, monkeypatch):
    """The number of tasks follows the slots, whatever small tables they unfold from."""
    monkeypatch.setattr(mixing, "TASK_SLOTS", 300)
    frame = mixing.slots(goals_of(spark, SIZES), 64, shards=5)
    sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1890 and len(sizes) >= 4


def test_shards_of_mixed_documents(docs):
    rows = mixing.mixed_documents(docs, block=16, shards=9, shard_col="shard").collect()
    assert {r["shard"] for r in rows} == set(range(9))
    plain = mixing.mixed_documents(docs, block=16, shards=9)
    assert plain.schema == docs.schema and sorted(r["text"] for r in plain.collect()) == sorted(r["text"] for r in rows)
    assert all(s["shard"] < 3 for r in mixing.mix(docs, shards=3).collect() for s in r["shards"])


def test_no_slots(spark):
    assert mixing.slots(goals_of(spark, {"d": (0, 0)})).count() == 0

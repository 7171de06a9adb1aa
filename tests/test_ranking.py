import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hopline.operators import ranking
from hopline.operators.ranking import arrival_rank


def _frame(spark, n=4000, hot=0.34, time=lambda rnd, i: rnd.randrange(0, 10_000)):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        g = 0 if rnd.random() < hot else rnd.randrange(1, 6)  # group 0 holds about a third of the rows
        rows.append((g, time(rnd, i), i, f"r{i}"))
    return spark.createDataFrame(rows, "g bigint, t bigint, id bigint, row_id string")


SHAPES = {
    "uniform": lambda rnd, i: rnd.randrange(0, 10_000),
    "one outlier": lambda rnd, i: 0 if i == 7 else 10**12 + rnd.randrange(0, 10_000),
    "one millisecond": lambda rnd, i: 1_700_000_000_000,
    "no time": lambda rnd, i: None,
    "some without time": lambda rnd, i: None if i % 3 == 0 else rnd.randrange(0, 90_000_000),
    "many days": lambda rnd, i: rnd.randrange(0, 40) * 86_400_000 + rnd.randrange(0, 5),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_rank_equals_row_number_and_no_slice_is_large(spark, shape, monkeypatch):
    df = _frame(spark, time=SHAPES[shape])
    by = Window.partitionBy("g").orderBy("t", "id")
    want = {r.id: (r.rn, r.n) for r in df.withColumn("rn", F.row_number().over(by)).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("g"))).collect()}
    for target in (64, 700, 1 << 20):
        monkeypatch.setattr(ranking, "FEW_BYTES", 0 if target == 700 else 64 << 20)  # both ways of summing up
        got = arrival_rank(df, ["g"], ["t", "id", "row_id"], target_rows=target)
        assert got.columns == [*df.columns, "rn", "group_rows"]
        assert {r.id: (r.rn, r.group_rows) for r in got.collect()} == want
        sliced = ranking.with_slices(df, ["t", "id", "row_id"], target, 1000)
        largest = sliced.groupBy("g", *ranking.SLICE).count().agg(F.max("count")).first()[0]
        assert largest <= 2 * target


def test_rows_are_exchanged_once_and_nothing_is_kept_in_executors(spark):
    df = _frame(spark, 300).withColumn("draw", F.md5("row_id"))
    for target in (64, 1 << 20):
        plan = arrival_rank(df, ["g"], ["t", "id", "row_id"], target_rows=target)._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryRelation" not in plan and plan.count("md5") == 1
        assert len(re.findall(r"Exchange hashpartitioning\(g#\d+L, _s0#", plan)) == 1 and "Sort [g" in plan


def test_a_slice_is_cut_where_it_is_crowded_only(spark):
    """One crowded second of one group: the spans of all others stay whole."""
    df = _frame(spark, 3000, time=lambda rnd, i: 50_000 if i < 500 else rnd.randrange(0, 40) * 3_600_000)
    sliced = ranking.with_slices(df, ["t", "id", "row_id"], 64, ranking.HOUR_MS, ["g"])
    cut = sliced.where("_s3 <> 0 OR _s2 <> 0").agg(F.min("t"), F.max("t"), F.countDistinct("g")).first()
    assert cut[0] == cut[1] == 50_000 and sliced.where("_s1 <> 0").count() < 800


def test_arrival_order_is_total_on_kafka_rows(spark):
    """Equal time and offset in four partitions: the windows do not depend on the input's order."""
    from hopline.operators.windows import count_window
    from hopline.plans.topology import Component
    from hopline.sources.kafka import spout

    rows = [(None, f"m{p}-{i}".encode(), "in", p, i, 1_700_000_000_000 + i // 7, 1) for i in range(100) for p in range(4)]
    schema = "key binary, value binary, topic string, partition int, offset bigint, ms bigint, timestampType int"

    def windows(order):
        kafka = spark.createDataFrame(order, schema).withColumn("timestamp", F.timestamp_millis("ms"))
        w = count_window(spout(kafka, Component("S", 0, lanes=1)), Component("W", 1, lanes=1), 20)
        return {r.row_id: (r.win, r.pos) for r in w.collect()}

    assert len(windows(rows)) == 400 and windows(rows) == windows(rows[::-1])

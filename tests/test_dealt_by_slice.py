"""Sources dealt by slices of the arrival order: windows get the same rows, and fanned-out rows stay in their tasks."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hopline.operators import fanout, ranking, windows
from hopline.operators.messages import path_adder, path_bolt
from hopline.plans import pipelines as P
from hopline.schema import ARRIVAL_ORDER, SLICED
from hopline.sources import kafka
from hopline.sources.kafka import events_as_inbound, spout
from tests.conftest import synthetic

COLS = ["row_id", "stream", "lane", "timestamp", "key", "entryMilliTimestamp", "messageID", "originTimestamp", "append_ms"]


@pytest.fixture(scope="module")
def events(spark):
    """Sparse and crowded times, some without a time, many at the same millisecond."""
    start = datetime(2024, 1, 1, 5)
    at = [start + timedelta(minutes=7 * i) for i in range(60)] + [start + timedelta(milliseconds=3 * i) for i in range(300)]
    at += [start + timedelta(days=40)] * 200 + [None] * 15
    return spark.createDataFrame([(i, t) for i, t in enumerate(at)], "event_id long, ts timestamp_ntz")


def dealt(events, messages=16, monkeypatch=None, **kw):
    if monkeypatch is not None:
        monkeypatch.setattr(kafka, "SLICE_MESSAGES", messages)
    out = events_as_inbound(events, partitions=6, by_time=True, **kw)
    assert SLICED in out.columns
    return out


def rows(df, cols=COLS):
    return sorted((tuple("" if v is None else str(v) for v in r) for r in df.select(*cols, F.array_join("path", ">").alias("p")).collect()))


def test_slices_are_bounded_ordered_and_in_one_task(spark, events, monkeypatch):
    d = dealt(events, monkeypatch=monkeypatch).withColumns({"task": F.spark_partition_id(), "t": F.unix_millis("timestamp")})
    assert d.count() == events.count()
    by = d.groupBy(SLICED).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks"),
                               F.min(F.struct("t", "event_id")).alias("a"), F.max(F.struct("t", "event_id")).alias("b")).orderBy(SLICED).collect()
    assert max(r.n for r in by if r.a.t is not None) <= 2 * 16 and all(r.tasks == 1 for r in by) and len(by) > 20
    assert by[0].a.t is None  # rows without a time come first
    assert all((x.b.t, x.b.event_id) < (y.a.t, y.a.event_id) for x, y in zip(by[1:], by[2:]))


@pytest.mark.parametrize("few_bytes", [64 << 20, 0])
def test_rank_is_that_of_a_row_number(spark, events, monkeypatch, few_bytes):
    monkeypatch.setattr(ranking, "FEW_BYTES", few_bytes)
    t = synthetic(lanes=3)
    fan = fanout.fanout_fixed(spout(dealt(events, monkeypatch=monkeypatch), t.component("S")), t.component("F"), 4)
    got = ranking.arrival_rank(fan, ["lane"], ARRIVAL_ORDER)
    whole = Window.partitionBy("lane")
    want = fan.withColumns({"rn": F.row_number().over(whole.orderBy(*ARRIVAL_ORDER)), "group_rows": F.count(F.lit(1)).over(whole)})
    told = lambda d: sorted((r.row_id, r.lane, r.rn, r.group_rows) for r in d.select("row_id", "lane", "rn", "group_rows").collect())
    assert told(got) == told(want) and got.count() == 4 * events.count()


@pytest.mark.parametrize("build", [P.all_in_one, P.fish, P.window, lambda i, t: P.window(i, t, group_by="path"),
                                   lambda i, t: P.fish(i, t, time_window_ms=2000)])
def test_pipelines_give_the_same(events, monkeypatch, build):
    timed = events.where("ts IS NOT NULL")
    plain = build(events_as_inbound(timed), synthetic())
    assert rows(build(dealt(timed, monkeypatch=monkeypatch), synthetic())) == rows(plain)


def test_windows_behind_other_stages(events, monkeypatch):
    def told(inbound):
        t = synthetic()
        w = path_adder(path_bolt(spout(inbound, t.component("S")), t.component("P")), t.component("A"))
        return rows(windows.emit_by_spout(w, t.component("W"), 10), [c for c in COLS if c != "append_ms"])
    assert told(dealt(events, monkeypatch=monkeypatch)) == told(events_as_inbound(events))


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_no_fanned_out_row_is_exchanged_for_its_rank(spark, events, monkeypatch, threshold):
    """Below the exchange of picks stands the one of the source only; the offsets come by broadcast, or meet the rows where they are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = P.all_in_one(dealt(events, monkeypatch=monkeypatch), synthetic())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    own = plan[:plan.index("hopline-table")]  # the side of the rows
    ops = [x.lstrip(" :+-").split(" ")[0] for x in own.split("\n")]
    assert ops.count("Generate") == 1 and "Exchange" in ops[ops.index("Generate"):]
    above = [x for x in own.split("\n")[:ops.index("Generate")] if x.lstrip(" :+-").startswith("Exchange")]
    assert len(above) == 1 and re.search(r"hashpartitioning\(lane#\d+L, win#\d+L", above[0])


def test_time_windows_of_slices_are_exchanged_once(events, monkeypatch):
    """Each slice hands on one partial result of a window and source stream, with what is emitted of its pick only."""
    inbound = dealt(events.where("ts IS NOT NULL"), 64, monkeypatch)
    lines = P.fish(inbound, synthetic(), time_window_ms=2000)._jdf.queryExecution().executedPlan().toString().split("\n")
    ops = [re.sub(r"^[ :+\-*()0-9]*", "", x) for x in lines]
    source = next(i for i, x in enumerate(ops) if x.startswith("Generate explode(CASE"))
    above = [i for i, x in enumerate(ops[:source]) if x.startswith("Exchange")]
    assert len(above) == 1 and re.search(r"hashpartitioning\(lane#\d+L, win#\d+L, stream#\d+, \d+\)", ops[above[0]])
    below = next(x for x in ops[above[0] + 1:] if not x.startswith("Project"))
    assert "Aggregate" in below and re.search(r"key=\[_slice#\d+, lane#\d+L, win#\d+L, stream#\d+\]", below)

    t = synthetic()
    routed = P.Routed({"kafkaMessages0": t.component("P"), "kafkaMessages1": (pm := t.component("M"))})
    front = P.fork_path_and_multiplier(spout(inbound, t.component("S"), num_streams=2), routed, pm)
    js = t.component("J")
    partials = windows.split_partials(windows.by_arrival_time(front, js, 2000), js, windows.EMITTED)
    by_window = front.transform(lambda d: windows.by_arrival_time(d, js, 2000)).select(SLICED, "lane", "win", "stream").distinct().count()
    assert windows.partials_of_slices(partials, js).count() <= by_window < partials.count() < front.count()

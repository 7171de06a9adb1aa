"""Streams with state: batches of any size, late rows, replays and killed writers give what one batch gives."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hopline.operators import fanout, messages, metrics, validate, windows
from hopline.operators.messages import to_outbound
from hopline.plans import pipelines as P
from hopline.plans.topology import Component
from hopline.sources.kafka import events_as_inbound, results_rows, spout
from hopline.streaming import pipelines as S
from hopline.streaming.count_window import stream_count_window
from hopline.streaming.event_time import LATE
from hopline.streaming.sinks import read_points, write_points
from hopline.streaming.table import CommittedTable
from tests.conftest import SF_SMALL, make_events, synthetic


def _stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _put(rows, folder):
    rows.coalesce(1).write.mode("append").parquet(folder)


def _chunks(rows, col, parts):
    """``rows`` in ``parts`` ranges of ``col``."""
    cuts = rows.approxQuantile(col, [i / parts for i in range(1, parts)], 0.0)
    bounds = [None, *cuts, None]
    for a, b in zip(bounds, bounds[1:]):
        yield rows.where((F.lit(True) if a is None else F.col(col) > a) & (F.lit(True) if b is None else F.col(col) <= b))


def _run(q):
    q.awaitTermination(300)
    assert q.exception() is None


def _told(frame, *cols):
    return Counter(map(tuple, frame.select(*cols).collect()))


def test_a_batch_is_whole_or_absent(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.read_before(9) is None
    table.write(spark.range(3), 0), table.write(spark.range(10, 12), 1)
    # a writer killed between its files and its commit, and one killed in the middle of a replay
    spark.range(100).write.parquet(str(tmp_path / "t/batch_id=2/attempt=00000000000000000001-dead"))
    spark.range(100).write.parquet(str(tmp_path / "t/batch_id=1/attempt=00000000000000000001-dead"))
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2, 10, 11]
    table.write(spark.range(20, 21), 1), table.write(spark.range(30, 31), 2)
    assert sorted(r.id for r in table.read().select("id").collect()) == [0, 1, 2, 20, 30]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [0, 1, 2, 20, 30]  # the dead attempts are gone
    assert [r.id for r in table.read_before(2).collect()] == [20]
    table.forget_before(2)
    assert sorted(table.committed()) == [2] and not os.path.exists(tmp_path / "t/batch_id=0")


def test_a_reader_sees_the_old_attempt_until_the_new_commit(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(3), 0)
    seen = []

    class Watched(CommittedTable):
        def _drop(self, batch_id, keep=None):  # both attempts are committed here
            seen.append(self.read().count())
            super()._drop(batch_id, keep)

    Watched(spark, str(tmp_path / "t")).write(spark.range(5), 0)
    assert seen == [5] and table.read().count() == 5


def test_points_are_committed(spark, tmp_path):
    points = P.receiver_points(to_outbound(P.basic(events_as_inbound(make_events(spark, 50)), synthetic())))
    write_points(points, str(tmp_path / "p"), 0), write_points(points, str(tmp_path / "p"), 0)
    assert read_points(spark, str(tmp_path / "p")).count() == 100
    assert set(os.listdir(next((tmp_path / "p/batch_id=0").iterdir()))) >= {"measurement=measured-kafka-latency"}


def test_a_hot_lane_is_ranked_by_many_tasks(spark, tmp_path):
    """One lane takes every row; batches of uneven size; the windows are the batch's, no Python runs, and a replay changes nothing."""
    comp = Component("W", 1, lanes=1)
    rows = spout(events_as_inbound(make_events(spark, 3000, step_ms=1)), Component("S", 0), num_streams=1)
    want = _told(windows.count_window(rows, comp, 7), "row_id", "win", "pos")
    windowed = stream_count_window(rows, comp, 7, target_rows=64)
    got = Counter()
    cuts = [0, 3, 3, 1500, 1501, 3000]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = rows.where((F.col("event_id") >= a) & (F.col("event_id") < b))
        windowed.step(batch, i, str(tmp_path / "s")).count()  # killed behind its state
        full = windowed.step(batch, i, str(tmp_path / "s"))
        assert "Python" not in full._jdf.queryExecution().executedPlan().toString()
        got += _told(full, "row_id", "win", "pos")
        assert CommittedTable(spark, str(tmp_path / "s/rows")).read(i).count() < 7
    assert got == want and len(got) == 2996
    assert len(CommittedTable(spark, str(tmp_path / "s/rows")).committed()) == 2  # this batch's state and the one before it


def test_time_windows_on_a_stream(spark, tmp_path):
    """Chunks in order with a restart: closed windows are the batch's; what is open stays in the state."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("_t", F.unix_millis(F.col("ts").cast("timestamp")))
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for i, c in enumerate(_chunks(ev, "_t", 3)):
        _put(c.drop("_t"), src)
        if i != 1:  # the second run sees two chunks
            _run(S.fish_time_to_table(events_as_inbound(_stream(spark, src)), out, ckpt, synthetic(), 60_000, 5_000, availableNow=True))
    cols = ["row_id", "stream", "lane", "key", "timestamp", "entryMilliTimestamp", "originTimestamp", "stormMilliLatencyMs", "sink"]
    want = _told(P.fish(events_as_inbound(ev), synthetic(), time_window_ms=60_000), *cols)
    got = _told(CommittedTable(spark, out).read(), *cols)
    assert got and not got - want
    state = CommittedTable(spark, f"{ckpt}/hopline-state/open").read_before(1 << 40)
    still = state.groupBy("lane", "win", "stream").count().count()
    assert sum((want - got).values()) == 2 * still < 100
    assert CommittedTable(spark, out + "_late").read().count() == 0


def test_late_rows_are_stored_with_a_reason(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ck"))
    first = make_events(spark, 200, step_ms=500)
    _put(first, src)
    run = lambda: _run(S.fish_time_to_table(
        events_as_inbound(_stream(spark, src)), out, ckpt, synthetic(), 2_000, 1_000, availableNow=True))
    run()
    _put(make_events(spark, 3, first_id=900), src)  # at the very start again
    run()
    late = CommittedTable(spark, out + "_late").read().collect()
    assert {r.event_id for r in late} == {900, 901, 902} and {r.reject_reason for r in late} == {LATE}
    front = P.fork_path_and_multiplier  # every row of the late messages is there: one by path, the copies by fan-out
    assert front and len(late) == 3 + sum(1 for r in late if r.stream == "Stream2")


def test_partial_results_merge_in_any_grouping(spark):
    js = Component("JoinSplitBolt", 3, clock=synthetic().clock)
    rows = windows.by_arrival_time(fanout.split_streams(messages.path_bolt(spout(
        events_as_inbound(make_events(spark, 400, step_ms=50)), Component("S", 0, clock=js.clock)), Component("P", 1, clock=js.clock)), "a", "b"), js, 4_000)
    whole = windows.split_partials(rows, js)
    parts = windows.split_partials(rows.where("event_id % 3 = 0"), js).unionByName(windows.split_partials(rows.where("event_id % 3 <> 0"), js))
    assert _told(windows.merged_partials(parts), *whole.columns[:5]) == _told(whole, *whole.columns[:5])
    cols = ["row_id", "stream", "lane", "win", "originTimestamp", "source_stream"]
    assert _told(windows.split_of_partials(windows.merged_partials(parts), js, 4_000), *cols) == _told(
        windows.split_of_partials(whole, js, 4_000), *cols)


def test_time_windows_over_a_batch_refuse_the_wall_clock(spark):
    with pytest.raises(ValueError, match="clock"):
        P.fish(events_as_inbound(make_events(spark, 5)), time_window_ms=2000)


def _kafka_rows(spark, n=1500):
    sent = to_outbound(P.basic(events_as_inbound(make_events(spark, n, step_ms=40)), synthetic()))
    return sent.withColumn("offset", F.col("row_id").cast("bigint"))


def test_count_reports_on_a_stream(spark, tmp_path):
    rows = _kafka_rows(spark)
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ck"))
    timed = rows.withColumn("_t", F.unix_millis("timestamp"))
    for i, c in enumerate(_chunks(timed, "_t", 4)):
        _put(c.drop("_t"), src)
        if i in (0, 3):  # a restart that finds three chunks
            _run(S.throughput_by_count_to_table(_stream(spark, src), out, ckpt, 30, availableNow=True))
    want = metrics.throughput_by_count(validate.accepted(validate.validate_payload(results_rows(rows))), 30)
    got = CommittedTable(spark, out).read()
    cols = want.columns
    assert _told(got, *cols) == _told(want, *cols) and got.count() > 40
    state = CommittedTable(spark, f"{ckpt}/hopline-state/reports").read_before(1 << 40).collect()
    assert sum(r.seen for r in state) == 1500 and len(state) == 4


def test_no_message_is_lost_by_time_buckets(spark, tmp_path):
    """Counts of the closed buckets, of the open ones and of the late rows add up to the input."""
    rows = _kafka_rows(spark, 600)
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ck"))
    run = lambda: _run(S.throughput_by_time_to_table(_stream(spark, src), out, ckpt, 2000, 3000, availableNow=True))
    _put(rows.where("offset >= 100"), src)
    run()
    _put(rows.where("offset < 100"), src)
    run()
    closed, late = CommittedTable(spark, out).read(), CommittedTable(spark, out + "_late").read()
    still = CommittedTable(spark, f"{ckpt}/hopline-state/open").read_before(1 << 40)
    sums = [closed.agg(F.sum("messages")).first()[0], still.agg(F.sum("messages")).first()[0], late.count()]
    assert sum(sums) == 600 and min(sums) > 0 and {r.reject_reason for r in late.collect()} == {LATE}
    batch = {r.bucket_start_ms: r.messages for r in metrics.throughput_by_time(validate.accepted(P.receiver(rows.where("offset >= 100")))).collect()}
    got = {r.bucket_start_ms: r.messages for r in closed.collect()}
    assert got and all(batch[k] == v for k, v in got.items())


def test_the_receiver_keeps_rejects_by_default(spark, tmp_path):
    rows = _kafka_rows(spark, 40)
    bad = rows.limit(7).withColumn("value", F.lit("no json").cast("binary"))
    rows.unionByName(bad).write.parquet(str(tmp_path / "in"))
    _run(S.receiver_to_points(_stream(spark, str(tmp_path / "in")), str(tmp_path / "p"), str(tmp_path / "ck"), availableNow=True))
    assert read_points(spark, str(tmp_path / "p")).count() == 80
    assert CommittedTable(spark, str(tmp_path / "p_rejected")).read().count() == 7


@pytest.mark.parametrize("name", ["f2f", "fish"])
def test_hop_latencies_beside_the_output_of_a_stream(spark, tmp_path, name):
    """Chunks in order with a restart: the sender rows are the batch's, and so is every hop latency, closed or still open."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("_t", F.unix_millis(F.col("ts").cast("timestamp")))
    src, out, lat, ckpt = (str(tmp_path / n) for n in ("in", "out", "lat", "ck"))
    for i, c in enumerate(_chunks(ev, "_t", 3)):
        _put(c.drop("_t"), src)
        if i != 1:
            _run(S.pipeline_to_tables(name, events_as_inbound(_stream(spark, src)), out, lat, ckpt, synthetic(), trigger={"availableNow": True}))
    batch = events_as_inbound(ev)
    cols = ["row_id", "lane", "timestamp", "key", "originTimestamp", "stormMilliLatencyMs", "sink", "append_ms"]
    assert _told(CommittedTable(spark, out).read(), *cols) == _told(P.PIPELINES[name](batch, synthetic()), *cols)
    want = metrics.transfer_latency(P.transfer_rows(name, batch, synthetic()))
    closed = CommittedTable(spark, lat).read()
    cols = ["component", "task", "bucket_start_ms", "transfers", "sum_ms", "max_ms"]
    still = CommittedTable(spark, f"{ckpt}/hopline-state/latency/open").read_before(1 << 40)
    late = CommittedTable(spark, lat + "_late").read()
    merged = closed.select(*cols).unionByName(still.select(*cols))
    if late.count():  # a window that fills in a later batch is received at its last tuple's time, never before the watermark
        raise AssertionError(late.count())
    assert _told(merged, *cols) == _told(want, *cols) and closed.count() > 10 * still.count()
    assert _told(closed, "component", "mean_ms") - _told(want, "component", "mean_ms") == Counter()

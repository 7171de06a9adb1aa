from pyspark.sql import functions as F

from hopline.operators import messages, windows
from hopline.plans import pipelines as P
from hopline.sources.kafka import events_as_inbound, spout
from tests.conftest import make_events, synthetic


def _one_lane(spark, n, *names):
    t = synthetic(lanes=1)
    comps = [t.component(x) for x in names]
    return spout(events_as_inbound(make_events(spark, n)), comps[0]), comps


def test_partial_window_dropped(spark):
    s, (_, w) = _one_lane(spark, 25, "TimerSpout", "W")
    out = windows.count_window(s, w, 10).collect()
    assert len(out) == 20 and {r.win for r in out} == {0, 1}
    assert sorted(r.pos for r in out) == list(range(1, 21))
    s9, (_, w9) = _one_lane(spark, 9, "TimerSpout", "W")
    assert windows.count_window(s9, w9, 10).count() == 0
    assert windows.emit_one(s9, w9, 10, create_path_msg=True).count() == 0


def test_windows_follow_arrival_order(spark):
    s, (_, w) = _one_lane(spark, 30, "TimerSpout", "W")
    out = windows.count_window(s, w, 10).orderBy("pos").collect()
    assert [r.event_id for r in out] == list(range(30))
    assert [r.win for r in out] == [i // 10 for i in range(30)]


def test_emit_one_pick_in_window_and_double_element(spark):
    s, (_, w) = _one_lane(spark, 40, "TimerSpout", "WindowedPathBolt")
    cw = {r.row_id: r.win for r in windows.count_window(s, w, 10).collect()}
    out = windows.emit_one(s, w, 10, create_path_msg=True).collect()
    assert len(out) == 4
    for r in out:
        assert cw[r.row_id] == r.win  # the pick belongs to its own window
        assert r.path[1] == r.path[2] == "WindowedPathBolt:2"
        assert r.originTimestamp == r.entryMilliTimestamp  # origin := entry := own entry


def test_emit_one_by_path_first_arrival_and_average(spark):
    s, (_, pb, w) = _one_lane(spark, 10, "TimerSpout", "PathBolt", "W")
    p = messages.path_bolt(s, pb)
    rows = p.collect()
    out = windows.emit_one(p, w, 10, group_by="path").collect()
    assert len(out) == 1
    r = out[0]
    entries = sorted(x.entryMilliTimestamp for x in rows)
    assert r.entryMilliTimestamp == sum(entries) // len(entries)  # one path: average over all
    first = min(rows, key=lambda x: (x.msg_ts, x.event_id))
    assert r.row_id == first.row_id  # first arrival of the chosen path


def test_emit_by_spout_three_spout_tasks(spark):
    t = synthetic(lanes=3)
    sp, pb = t.component("TimerSpout"), t.component("PathBolt")
    w = synthetic(lanes=1, seed=t.seed)
    for name in ("TimerSpout", "PathBolt"):
        w.component(name)
    wc = w.component("W")
    p = messages.path_bolt(spout(events_as_inbound(make_events(spark, 60)), sp), pb)
    out = windows.emit_by_spout(p, wc, 60).collect()
    assert len(out) == 3 and sorted(r.spout_task for r in out) == [1, 2, 3]
    rows = p.withColumn("st", F.split(F.element_at("path", 1), ":")[1].cast("bigint")).collect()
    for r in out:
        entries = [x.entryMilliTimestamp for x in rows if x.st == r.spout_task]
        assert r.entryMilliTimestamp == sum(entries) // len(entries)  # truncating integer average
        assert r.originTimestamp == r.entryMilliTimestamp


def test_emit_all_reemits_with_origin_entry(spark):
    s, (_, pb, w) = _one_lane(spark, 20, "TimerSpout", "PathBolt", "W")
    out = windows.emit_all(messages.path_bolt(s, pb), w, 10).collect()
    assert len(out) == 20
    assert all(r.entryMilliTimestamp == r.originTimestamp and len(r.path) == 3 for r in out)


def test_join_split_one_stream_window(spark):
    s, (_, pb, js) = _one_lane(spark, 20, "TimerSpout", "PathBolt", "JoinSplitBolt")
    p = messages.path_bolt(s, pb, out_stream="Stream1")
    out = windows.join_split(p, js, 20).collect()
    assert len(out) == 2  # one tuple before the split, two after
    assert {r.stream for r in out} == {"Stream3", "Stream4"} and len({r.row_id for r in out}) == 1


def test_fish_invariants(spark):
    inb = events_as_inbound(make_events(spark, 400))
    out = P.fish(inb, synthetic())
    rows = out.collect()
    assert rows and all(len(r.path) == 4 for r in rows)
    assert {r.sink for r in rows} == {"SenderBoltA", "SenderBoltB"}
    a = sorted((r.row_id, r.messageID) for r in rows if r.sink == "SenderBoltA")
    b = sorted((r.row_id, r.messageID) for r in rows if r.sink == "SenderBoltB")
    assert a == b  # the split sends the same tuple to both senders


def test_fish_plan_single_pass(spark):
    plan = P.fish(events_as_inbound(make_events(spark, 50)), synthetic())._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan  # the two spout streams come from one scan through explode
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_all_pipeline_amplification(spark):
    out = P.all_in_one(events_as_inbound(make_events(spark, 100)), synthetic()).count()
    # 100 messages x 20 copies over 16 lanes, windows of 10: at most 200, at least 200 - 16
    assert 184 <= out <= 200


def test_join_split_pick_and_average_invariants(spark):
    from hopline.plans.topology import Routed

    t = synthetic()
    sp = t.component("TimerSpout")
    pb, pm = t.component("PathBolt"), t.component("PathMultiplier")
    s = spout(events_as_inbound(make_events(spark, 300)), sp, num_streams=2)
    front = P.fork_path_and_multiplier(s, Routed({"kafkaMessages0": pb, "kafkaMessages1": pm}), pm)
    js = t.component("JoinSplitBolt")
    cw = windows.count_window(front, js, 20)
    members = {}
    for r in cw.collect():
        members.setdefault((r.lane, r.win, r.stream), []).append(r)
    out = windows.join_split(front, js, 20).where("stream = 'Stream3'").collect()
    assert out
    for r in out:
        rows = members[(r.lane, r.win, r.source_stream)]
        picked = [x for x in rows if x.row_id == r.row_id]
        assert len(picked) == 1  # the pick belongs to its window and source stream
        same_path = [x.originTimestamp for x in rows if x.path == picked[0].path]
        assert r.entryMilliTimestamp == r.originTimestamp == sum(same_path) // len(same_path)
        assert min(same_path) <= r.originTimestamp <= max(same_path)
        assert r.path[:-1] == picked[0].path and r.path[-1].startswith("JoinSplitBolt:")

"""The two-step picks of count windows against a plain model, with windows that lie in many slices."""

import hashlib

import pytest
from pyspark.sql import functions as F

from hopline.operators import windows
from hopline.operators.ranking import SLICE
from hopline.plans import pipelines as P
from hopline.plans.topology import Routed
from hopline.sources.kafka import events_as_inbound, spout
from tests.conftest import make_events, synthetic

SLICED = {"target_rows": 4, "width_ms": 3000}  # a window of 20 lies in several slices


def h(*values):
    return int(hashlib.md5("|".join(map(str, values)).encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def front(spark):
    """The tuples of both fish branches and the component that windows them; some times coincide."""
    t = synthetic(lanes=3)
    sp, pb, pm = (t.component(c) for c in ("TimerSpout", "PathBolt", "PathMultiplier"))
    s = spout(events_as_inbound(make_events(spark, 60, step_ms=400)), sp, num_streams=2)
    rows = P.fork_path_and_multiplier(s, Routed({"kafkaMessages0": pb, "kafkaMessages1": pm}), pm)
    return spark.createDataFrame(rows.collect(), rows.schema), t.component("JoinSplitBolt")


def members(front, comp, n, **kw):
    out = {}
    for r in windows.count_window(front, comp, n, **kw).orderBy("pos").collect():
        out.setdefault((r.lane, r.win), []).append(r)
    assert out and all(len(v) == n for v in out.values())
    return out


def pick(comp, rows):
    return min(rows, key=lambda r: (h(comp.seed, comp.name, "lane", r.row_id), r.row_id, r.pos))


def fired(comp, rows):
    return max(r.timestamp for r in rows) + h(rows[0].lane, rows[0].win, comp.name, "clock") % 50


def by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


def path(r):
    return " ".join(r.path)


def told(df, *more):
    return sorted((r.lane, r.win, r.row_id, r.timestamp, r.entryMilliTimestamp, r.originTimestamp, *[r[m] for m in more]) for r in df.collect())


@pytest.mark.parametrize("kw", [{}, SLICED])
def test_windows_lie_in_several_slices(front, kw):
    rows, comp = front
    w = windows.count_window(rows, comp, 20, **kw)
    assert set(SLICE) <= set(w.columns)
    spread = w.groupBy("lane", "win").agg(F.count_distinct(*SLICE).alias("n")).agg(F.max("n")).first()[0]
    assert spread > 3 if kw else spread == 1


@pytest.mark.parametrize("kw", [{}, SLICED])
def test_join_split(front, kw):
    rows, comp = front
    want = []
    for (lane, win), inside in members(rows, comp, 20, **kw).items():
        for stream, mine in by(inside, lambda r: r.stream).items():
            paths = by(mine, path)
            chosen = paths[min(paths, key=lambda p: (h(comp.seed, comp.name, "path", lane, win, stream, p), p))]
            avg = sum(r.originTimestamp for r in chosen) // len(chosen)
            want.append((lane, win, pick(comp, chosen).row_id, fired(comp, inside), avg, avg, stream))
    got = windows.join_split(rows, comp, 20, **kw).where("stream = 'Stream3'")
    assert told(got, "source_stream") == sorted(want)


@pytest.mark.parametrize("kw", [{}, SLICED])
def test_by_spout(front, kw):
    rows, comp = front
    want = []
    for (lane, win), inside in members(rows, comp, 20, **kw).items():
        for task, mine in by(inside, lambda r: int(r.path[0].split(":")[1])).items():
            avg = sum(r.entryMilliTimestamp for r in mine) // len(mine)
            want.append((lane, win, pick(comp, mine).row_id, fired(comp, inside), avg, avg, task))
    assert told(windows.emit_by_spout(rows, comp, 20, **kw), "spout_task") == sorted(want)


@pytest.mark.parametrize("kw", [{}, SLICED])
def test_one_by_path_and_by_tuple(front, kw):
    rows, comp = front
    by_path, by_tuple = [], []
    for (lane, win), inside in members(rows, comp, 20, **kw).items():
        paths = by(inside, path)
        chosen = paths[min(paths, key=lambda p: (h(comp.seed, comp.name, "path", lane, win, p), p))]
        avg = sum(r.entryMilliTimestamp for r in chosen) // len(chosen)
        by_path.append((lane, win, chosen[0].row_id, fired(comp, inside), avg, avg))
        one = pick(comp, inside)
        by_tuple.append((lane, win, one.row_id, fired(comp, inside), one.entryMilliTimestamp, one.entryMilliTimestamp))
    assert told(windows.emit_one(rows, comp, 20, group_by="path", **kw)) == sorted(by_path)
    assert told(windows.emit_one(rows, comp, 20, **kw)) == sorted(by_tuple)


def test_a_row_that_comes_twice_gives_one_pick(front):
    rows, comp = front
    twice = rows.unionByName(rows)
    n_windows = len(members(twice, comp, 20, **SLICED))
    assert windows.emit_one(twice, comp, 20, **SLICED).count() == n_windows
    streams = windows.count_window(twice, comp, 20, **SLICED).select("lane", "win", "stream").distinct().count()
    assert windows.join_split(twice, comp, 20, **SLICED).count() == 2 * streams


def test_only_picks_cross_the_exchange_by_window(front):
    """Under the exchange on (lane, win) stands the filter of the step inside slices, and that step adds no exchange."""
    rows, comp = front
    for df in (windows.join_split(rows, comp, 20), windows.emit_one(rows, comp, 20)):
        ops = [line.lstrip(" :+-").split(" ")[:3] for line in df._jdf.queryExecution().executedPlan().toString().split("\n")]
        names = [o[0] for o in ops]
        at = next(i for i, o in enumerate(ops) if o[0] == "Exchange" and "lane" in " ".join(o))
        below = [x for x in names[at + 1:] if x != "Project"]
        assert below[0] == "Filter" and below[1] == "Window"
        inside = below[:below.index("Exchange")]
        assert inside.count("Sort") == 2  # the rank's, and one for all windows inside a slice
        assert names[:at].count("Exchange") == 0


@pytest.mark.parametrize("times", ["spread", "one window"])
def test_time_join_split(front, times):
    """Every row twice, the second time with a later entry; in one case all arrive in one window."""
    rows, comp = front
    if times == "one window":
        rows = rows.withColumn("timestamp", F.lit(8_000_000).cast("bigint"))
    rows = rows.unionByName(rows)
    window_ms = 4000
    inside = {}
    for r in windows.by_arrival_time(rows, comp, window_ms).collect():
        inside.setdefault((r.lane, r.win, r.stream), []).append(r)
    want = []
    for (lane, win, stream), mine in inside.items():
        paths = by(mine, path)
        chosen = paths[min(paths, key=lambda p: (h(comp.seed, comp.name, "path", lane, win, stream, p), p))]
        one = min(chosen, key=lambda r: (h(comp.seed, comp.name, "lane", r.row_id), r.row_id))
        avg = sum(r.originTimestamp for r in chosen) // len(chosen)
        want.append((lane, win, one.row_id, (win + 1) * window_ms, avg, avg, stream))
    if times == "one window":
        assert len({k[:2] for k in inside}) <= comp.lanes and max(map(len, inside.values())) > 50
    got = windows.join_split_time(rows, comp, window_ms)
    assert told(got.where("stream = 'Stream3'"), "source_stream") == told(got.where("stream = 'Stream4'"), "source_stream") == sorted(want)


def test_time_windows_exchange_partial_results_only(front):
    rows, comp = front
    plan = windows.join_split_time(rows, comp)._jdf.queryExecution().executedPlan().toString().split("\n")
    names = [line.lstrip(" :+-*()0123456789").split("(")[0].split(" ")[0] for line in plan]
    at = [i for i, name in enumerate(names) if name == "Exchange"]
    assert len(at) == 2 and all(names[i + 1].endswith("Aggregate") and "partial_" in plan[i + 1] for i in at)
    assert "Window" not in names

from pyspark.sql import functions as F

from hopline.operators import fanout, lanes
from hopline.plans import pipelines as P
from hopline.sources.kafka import events_as_inbound, spout
from tests.conftest import make_events, synthetic


def test_fixed_fanout_copies_share_message(spark):
    t = synthetic()
    sp, mp = t.component("TimerSpout"), t.component("MultiPathBolt")
    out = fanout.fanout_fixed(spout(events_as_inbound(make_events(spark, 30)), sp), mp, 10)
    assert out.count() == 300
    per = out.groupBy("event_id").agg(F.count("*").alias("n"), F.countDistinct("messageID").alias("ids"),
                                      F.countDistinct(F.array_join("path", ">")).alias("paths"),
                                      F.countDistinct("row_id").alias("rows"), F.min("copy").alias("lo"),
                                      F.max("copy").alias("hi"))
    for r in per.collect():
        assert (r.n, r.ids, r.paths, r.rows, r.lo, r.hi) == (10, 1, 1, 10, 0, 9)


def test_normal_fanout_zero_emits_nothing(spark):
    t = synthetic()
    sp, pm = t.component("TimerSpout"), t.component("PathMultiplier")
    s = spout(events_as_inbound(make_events(spark, 400)), sp)
    draws = s.select("row_id", fanout.multiplier_draw(pm, 1, 20, 20, 1.0).alias("m"))
    out = fanout.fanout_normal(s, pm, 1, 20, 20, 1.0)
    expected = draws.agg(F.sum("m")).first()[0]
    assert out.count() == expected
    zero_ids = {r.row_id for r in draws.where("m = 0").collect()}
    assert zero_ids and not ({r.event_id for r in out.collect()} & {int(z) for z in zero_ids})


def test_split_streams_and_lane_load(spark):
    out = P.basic(events_as_inbound(make_events(spark, 100)), synthetic())
    sp = fanout.split_streams(out, "Stream3", "Stream4")
    assert sp.count() == 200 and {r.stream for r in sp.collect()} == {"Stream3", "Stream4"}
    t = synthetic()
    t.component("A")
    b = t.component("B")
    load = lanes.lane_load(out.withColumn("lane", lanes.fields_lane(b, "key")), b).collect()
    assert sum(r.rows for r in load) == 100
    assert all(17 <= r.task <= 32 for r in load)

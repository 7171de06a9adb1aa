import json

from pyspark.sql import functions as F

from hopline.operators import messages
from hopline.plans import pipelines as P
from hopline.sources.kafka import events_as_inbound, spout
from tests.conftest import make_events, synthetic


def test_spout_and_path_bolt(spark):
    inb = events_as_inbound(make_events(spark, 5))
    t = synthetic()
    sp, pb = t.component("TimerSpout"), t.component("PathBolt")
    s = spout(inb, sp)
    rows = s.collect()
    assert all(r.path.startswith("TimerSpout:") for r in rows)
    assert all(r.entryMilliTimestamp >= r.messageTimestamp for r in rows)
    assert all(len(r.uuid) == 36 and r.uuid.count("-") == 4 for r in rows)
    p = messages.path_bolt(s, pb).collect()
    for r in p:
        assert r.path[0].startswith("TimerSpout:") and r.path[1].startswith("PathBolt:")
        assert r.stormMilliLatencyMs == 0.0
        assert r.key in "ABCDEFGHIJKLMNOP"
        assert 16 < int(r.path[1].split(":")[1]) <= 32  # PathBolt is component 1 of 16 lanes


def test_send_stage_latency_and_json(spark):
    out = P.basic(events_as_inbound(make_events(spark, 20)), synthetic())
    rows = out.select("*", messages.payload(out).alias("value")).collect()
    for r in rows:
        assert r.stormMilliLatencyMs == float(r.timestamp - r.entryMilliTimestamp)
        assert r.stormMilliLatencyMs >= 0
        assert r.append_ms >= r.timestamp
        v = json.loads(r.value)
        assert list(v) == ["messageID", "originTimestamp", "stormMilliLatencyMs", "path"]
        assert len(v["path"]) == 3 and v["path"][-1].startswith("SenderBolt:")


def test_f2f_fields_grouping_same_key_same_task(spark):
    out = P.f2f(events_as_inbound(make_events(spark, 300)), synthetic())
    # the sender groups by the adder's key: one key, one sender task
    by_key = out.groupBy("key").agg(F.countDistinct("lane").alias("lanes")).collect()
    assert all(r.lanes == 1 for r in by_key)
    assert all(len(r.path) == 4 for r in out.collect())


def test_kafka_options():
    from hopline.operators.messages import kafka_sink_options
    from hopline.sources.kafka import kafka_source_options

    src = kafka_source_options("broker:9092", "beforeStorm", "spout_group", max_per_trigger=1)
    assert src["subscribe"] == "beforeStorm" and src["startingOffsets"] == "latest"
    assert src["maxOffsetsPerTrigger"] == "1" and src["kafka.group.id"] == "spout_group"
    sink = kafka_sink_options("broker:9092", "/ckpt")
    assert sink["kafka.acks"] == "all" and "kafka.retries" not in sink


def test_rows_are_lost_only_by_option():
    from hopline.operators.messages import FIRE_AND_FORGET, kafka_sink_options
    from hopline.sources.kafka import kafka_source_options

    assert kafka_source_options("b", "t", "g")["failOnDataLoss"] == "true"
    assert kafka_source_options("b", "t", "g", fail_on_data_loss=False)["failOnDataLoss"] == "false"
    sink = kafka_sink_options("b", "/c", **FIRE_AND_FORGET)
    assert sink["kafka.acks"] == "0" and sink["kafka.retries"] == "0"


def test_times_are_not_invented_by_default(spark):
    import pytest

    from hopline.functions.clock import WallClock
    from hopline.plans.topology import Component, Topology

    assert isinstance(Topology().clock, WallClock) and isinstance(Component("x", 0).clock, WallClock)
    with pytest.raises(ValueError):
        P.round_trip(events_as_inbound(make_events(spark, 5)))


def test_spout_on_bare_kafka_rows(spark):
    from datetime import datetime

    from hopline.schema import KAFKA_ROW

    rows = [(None, b"11111111-2222-3333-4444-555555555555", "beforeStorm", 2, 7, datetime(2024, 1, 1, 0, 0, 1), 0),
            (None, b"66666666-2222-3333-4444-555555555555", "beforeStorm", 2, 8, datetime(2024, 1, 1, 0, 0, 2), 0)]
    kafka = spark.createDataFrame(rows, KAFKA_ROW)
    t = synthetic()
    out = spout(kafka, t.component("TimerSpout")).orderBy("event_id").collect()
    assert [r.row_id for r in out] == ["beforeStorm/2/7", "beforeStorm/2/8"]
    assert [r.event_id for r in out] == [7, 8]
    assert out[0].uuid == "11111111-2222-3333-4444-555555555555"
    assert out[1].messageTimestamp - out[0].messageTimestamp == 1000

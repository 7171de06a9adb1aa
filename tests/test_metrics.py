from pyspark.sql import functions as F

from hopline.operators import metrics
from hopline.plans import pipelines as P
from hopline.sources.kafka import events_as_inbound
from tests.conftest import make_events, synthetic


def test_throughput_by_count_off_by_one(spark):
    rows = [(0, 1_000 + 10 * i, i) for i in range(1002)]
    df = spark.createDataFrame(rows, "partition int, kafka_ts bigint, offset bigint")
    out = metrics.throughput_by_count(df, n=500).orderBy("report_no").collect()
    assert [r.messages for r in out] == [500, 500]
    assert [r.end_ms for r in out] == [1_000 + 10 * 500, 1_000 + 10 * 1001]  # the 501st and 1002nd messages
    assert out[0].start_ms == 1_000 and out[1].start_ms == out[0].end_ms
    assert out[0].rate_mps == 500 * 1000.0 / (10 * 500)


def test_throughput_by_time(spark):
    df = spark.createDataFrame([(0, t) for t in (0, 1, 1999, 2000, 4500)], "partition int, kafka_ts bigint")
    got = {r.bucket_start_ms: r.messages for r in metrics.throughput_by_time(df, 2000).collect()}
    assert got == {0: 3, 2000: 1, 4000: 1}


def test_transfer_latency_counts_every_tuple_received(spark):
    inbound = events_as_inbound(make_events(spark, 1000))

    def received(name):
        rows = P.transfer_rows(name, inbound, synthetic())
        m = metrics.transfer_latency(rows, 2000)
        assert m.where("mean_ms < 0").count() == 0
        return {r.component: r.n for r in m.groupBy("component").agg(F.sum("transfers").alias("n")).collect()}

    assert received("basic") == {"PathBolt": 1000, "SenderBolt": 1000}
    assert received("multi") == {"MultiPathBolt": 1000, "SenderBolt": 10_000}
    window = received("window")
    assert window["WindowedPathBolt"] == 10 * window["SenderBolt"]  # all tuples of full windows, one sent of ten
    fish = received("fish")
    assert fish["PathBolt"] == fish["PathMultiplier"] == 1000 and fish["SenderBoltA"] == fish["SenderBoltB"]
    assert fish["JoinSplitBolt"] % 20 == 0 and fish["JoinSplitBolt"] > 10_000


def test_key_distribution_against_weights(spark):
    out = P.multi(events_as_inbound(make_events(spark, 500)), synthetic())
    kd = metrics.key_distribution(out).collect()
    assert len(kd) == 16 and sum(r.observed for r in kd) == 5000
    assert abs(sum(r.share for r in kd) - 1.0) < 1e-9
    assert all(abs(r.share - r.weight) < 0.03 for r in kd)


def test_metric_tags_fields(spark):
    df = spark.createDataFrame(
        [("measured-kafka-latency", "TimerSpout", 3, None, None, 17, None, "a>b")],
        "measurement string, spout_component string, spout_task bigint, sink_component string, sink_task bigint, "
        "value bigint, ms_latency_ms double, path string",
    )
    r = metrics.metric_tags_fields(df).first()
    assert r.tags == {"spout_component": "TimerSpout", "spout_task": "3"}
    assert r.fields == {"value": "17", "path": "a>b"}

"""Streaming: ordered file chunks against the batch result, contents not just counts,
and a restart from the checkpoint in the middle of the stream."""

import os
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from hopline.plans import pipelines as P
from hopline.sources.kafka import events_as_inbound
from hopline.streaming import pipelines as S
from tests.conftest import SF_SMALL, synthetic

COLS = ["row_id", "lane", "timestamp", "key", "entryMilliTimestamp", "originTimestamp", "stormMilliLatencyMs",
        "append_ms"]


def _chunks(spark, root, parts=4):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    qs = ev.approxQuantile("event_id", [i / parts for i in range(1, parts)], 0.0)
    ts = sorted(ev.orderBy("ts").select("ts").collect()[int(len(ev.collect()) * i / parts)].ts for i in range(1, parts))
    bounds = [None] + ts + [None]
    paths = []
    for i in range(parts):
        c = ev
        if bounds[i] is not None:
            c = c.where(F.col("ts") >= F.lit(bounds[i]))
        if bounds[i + 1] is not None:
            c = c.where(F.col("ts") < F.lit(bounds[i + 1]))
        p = os.path.join(root, f"chunk{i}")
        c.coalesce(1).write.parquet(p)
        paths.append(p)
    return ev, paths, qs


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS, F.array_join("path", ">").alias("p")).collect())


def _run(spark, build, src, out, ckpt):
    ev_schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    stream = spark.readStream.schema(ev_schema).option("maxFilesPerTrigger", 1).parquet(src)
    w, finish = build(events_as_inbound(stream), synthetic())
    q = S.run_to_table(w, finish, out, ckpt, availableNow=True)
    q.awaitTermination(300)
    assert q.exception() is None


@pytest.mark.parametrize("build,batch", [(S.window_stream, P.window), (S.fish_stream, P.fish),
                                         (S.all_stream, P.all_in_one)])
def test_stream_matches_batch_with_restart(spark, build, batch):
    root = tempfile.mkdtemp(prefix="hopline-stream-")
    ev, chunks, _ = _chunks(spark, root)
    src, out, ckpt = os.path.join(root, "in"), os.path.join(root, "out"), os.path.join(root, "ckpt")
    os.makedirs(src)
    # first run sees only the first chunk; the second run resumes from the checkpoint
    for i, c in enumerate(chunks):
        for f in sorted(os.listdir(c)):
            if f.endswith(".parquet"):
                os.link(os.path.join(c, f), os.path.join(src, f"part{i}-{f}"))
        if i == 0:
            _run(spark, build, src, out, ckpt)
    _run(spark, build, src, out, ckpt)
    got = spark.read.parquet(out)
    want = batch(events_as_inbound(ev), synthetic())
    assert got.count() == want.count() > 0
    assert _rows(got) == _rows(want)


def test_receiver_stream_points(spark):
    root = tempfile.mkdtemp(prefix="hopline-recv-")
    from hopline.operators.messages import to_outbound
    from hopline.sources.fixtures import corrupt_payload

    out_rows = corrupt_payload(P.basic(events_as_inbound(spark.read.parquet(f"{SF_SMALL}/events.parquet")), synthetic()))
    src = os.path.join(root, "in")
    out_rows.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(out_rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = S.receiver_to_points(stream, os.path.join(root, "points"), os.path.join(root, "ckpt"), availableNow=True)
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(root, "points")).drop("batch_id")
    want = P.receiver_points(out_rows)
    assert got.count() == want.count() > 0
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert to_outbound  # imported for the Kafka row shape


def test_throughput_by_time_stream_watermark(spark):
    from hopline.operators import metrics, validate
    from hopline.sources.fixtures import corrupt_payload

    root = tempfile.mkdtemp(prefix="hopline-m5-")
    rows = corrupt_payload(P.basic(events_as_inbound(spark.read.parquet(f"{SF_SMALL}/events.parquet")), synthetic()))
    ts = sorted(r.t for r in rows.select(F.unix_millis("timestamp").alias("t")).where("t IS NOT NULL").collect())
    cuts = [ts[len(ts) // 3], ts[2 * len(ts) // 3]]
    src = os.path.join(root, "in")
    t = F.unix_millis("timestamp")
    for i, cond in enumerate([t < cuts[0], (t >= cuts[0]) & (t < cuts[1]), t >= cuts[1]]):
        rows.where(cond).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (S.throughput_by_time_stream(stream).writeStream.format("memory").queryName("m5")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    rows_out = spark.sql("SELECT * FROM m5").collect()
    assert all(r.rate_mps == r.messages / 2 for r in rows_out)  # a bucket of two seconds
    got = {r.bucket_start_ms: r.messages for r in rows_out}
    acc = validate.accepted(P.receiver(rows))
    want = {r.bucket_start_ms: r.messages for r in metrics.throughput_by_time(acc, 2000).collect()}
    assert got and all(want[k] == v for k, v in got.items())  # every emitted bucket is exact
    assert len(got) >= len(want) - 2  # only buckets the final watermark has not passed stay open


def test_stream_rate_goes_by_the_buckets_length(spark):
    import datetime

    root = tempfile.mkdtemp(prefix="hopline-m5m-")
    value = '{"messageID":"m","originTimestamp":1,"stormMilliLatencyMs":1.0,"path":["A:1","B:2"]}'
    start = datetime.datetime(2024, 1, 1)
    times = [start + datetime.timedelta(seconds=s) for s in (*range(30), 600)]
    rows = [(None, value.encode(), "t", 0, i, t, 1) for i, t in enumerate(times)]
    from hopline.schema import KAFKA_ROW

    spark.createDataFrame(rows, KAFKA_ROW).coalesce(1).write.parquet(os.path.join(root, "in"))
    stream = spark.readStream.schema(KAFKA_ROW).parquet(os.path.join(root, "in"))
    q = (S.throughput_by_time_stream(stream, "1 minute").writeStream.format("memory").queryName("m5m")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert [(r.messages, r.rate_mps) for r in spark.sql("SELECT * FROM m5m").collect()] == [(30, 0.5)]


def test_receiver_stores_both_sides(spark):
    from hopline.operators import validate
    from hopline.run import run
    from hopline.sources.fixtures import corrupt_payload

    root = tempfile.mkdtemp(prefix="hopline-quarantine-")
    corrupt_payload(P.basic(events_as_inbound(spark.read.parquet(f"{SF_SMALL}/events.parquet")), synthetic())).write.parquet(
        os.path.join(root, "in"))
    rows = P.receiver(spark.read.parquet(os.path.join(root, "in")))
    want = {r.outcome: r.rows for r in validate.reject_counts(rows).collect()}
    for mode in ("batch", "stream"):
        out, bad = os.path.join(root, mode), os.path.join(root, mode + "-bad")
        run(spark, "receiver", os.path.join(root, "in"), out, stream=mode == "stream", checkpoint=os.path.join(root, "ck"), quarantine=bad)
        got = {r.reject_reason: r["count"] for r in spark.read.parquet(bad).groupBy("reject_reason").count().collect()}
        assert got == {k: v for k, v in want.items() if k != "accepted"}
        assert spark.read.parquet(out).count() == 2 * want["accepted"]


@pytest.mark.parametrize("build,emit", [(S.emit_all_stream, "emit_all"), (S.emit_by_spout_stream, "emit_by_spout")])
def test_other_windowed_stages_on_a_stream(spark, build, emit):
    from hopline.operators import messages, windows
    from hopline.sources.kafka import spout

    root = tempfile.mkdtemp(prefix="hopline-w23-")
    ev, chunks, _ = _chunks(spark, root)
    src, out = os.path.join(root, "in"), os.path.join(root, "out")
    os.makedirs(src)
    for i, c in enumerate(chunks):
        for f in sorted(os.listdir(c)):
            if f.endswith(".parquet"):
                os.link(os.path.join(c, f), os.path.join(src, f"part{i}-{f}"))
    _run(spark, build, src, out, os.path.join(root, "ckpt"))
    t = synthetic()
    p = messages.path_bolt(spout(events_as_inbound(ev), t.component("TimerSpout")), t.component("PathBolt"))
    want = getattr(windows, emit)(p, t.component("WindowedPathBolt"), 10)
    cols = ["row_id", "lane", "win", "timestamp", "key", "entryMilliTimestamp", "originTimestamp"]
    assert sorted(map(tuple, spark.read.parquet(out).select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_run_on_kafka_options(spark, monkeypatch):
    """Without a broker: the source's options, and the same code on the rows that it would give."""
    import hopline.run as R
    from hopline.schema import KAFKA_ROW

    root = tempfile.mkdtemp(prefix="hopline-kafka-")
    rows = events_as_inbound(spark.read.parquet(f"{SF_SMALL}/events.parquet")).select(*[f.name for f in KAFKA_ROW])
    rows.write.parquet(os.path.join(root, "in"))
    seen = {}

    def source(spark, servers, topic, group, max_per_trigger):
        seen["source"] = (servers, topic, group, max_per_trigger)
        return spark.readStream.schema(rows.schema).parquet(os.path.join(root, "in"))

    class Ended:
        def awaitTermination(self):
            pass

    def sink(sent, servers, checkpoint, topic):
        seen["sink"] = (servers, topic, sent.isStreaming, "stormMilliLatencyMs" in sent.columns)
        return Ended()

    def windowed(stream, finish, servers, checkpoint, topic, trigger):
        seen["windowed"] = (servers, topic, stream.isStreaming, trigger)
        return Ended()

    monkeypatch.setattr(R, "read_kafka_stream", source)
    monkeypatch.setattr(R, "kafka_sink", sink)
    monkeypatch.setattr(R.S, "run_to_kafka", windowed)
    options = dict(stream=True, checkpoint=os.path.join(root, "ck"), kafka_servers="broker:9092", kafka_group="g",
                   offsets_per_trigger=50, to_kafka=True)
    R.run(spark, "f2f", "beforeStorm", "afterStorm", **options)
    assert seen == {"source": ("broker:9092", "beforeStorm", "g", 50), "sink": ("broker:9092", "afterStorm", True, True)}
    R.run(spark, "window", "beforeStorm", "afterStorm", **options)
    assert seen["windowed"] == ("broker:9092", "afterStorm", True, {})
    with pytest.raises(SystemExit):
        R.run(spark, "receiver", "afterStorm", "points", **options)


def test_console_sink_runs(spark, capfd):
    from hopline.streaming.sinks import console_sink

    root = tempfile.mkdtemp(prefix="hopline-console-")
    spark.read.parquet(f"{SF_SMALL}/events.parquet").limit(5).write.parquet(os.path.join(root, "in"))
    schema = spark.read.parquet(os.path.join(root, "in")).schema
    stream = P.basic(events_as_inbound(spark.readStream.schema(schema).parquet(os.path.join(root, "in"))), synthetic())
    q = console_sink(stream.select("row_id", F.array_join("path", ">").alias("path")), availableNow=True)
    q.awaitTermination(120)
    assert q.exception() is None


def test_run_entry_point_batch_and_stream(spark):
    from hopline.run import run

    root = tempfile.mkdtemp(prefix="hopline-run-")
    ev = f"{SF_SMALL}/events.parquet"
    run(spark, "basic", ev, os.path.join(root, "basic"), synthetic_clock=True)
    out = spark.read.parquet(os.path.join(root, "basic"))
    assert out.count() == spark.read.parquet(ev).count()
    assert set(out.columns) >= {"value", "timestamp", "timestampType", "partition"}
    run(spark, "receiver", os.path.join(root, "basic"), os.path.join(root, "points"))
    assert spark.read.parquet(os.path.join(root, "points")).count() == 2 * out.count()
    spark.read.parquet(ev).write.parquet(os.path.join(root, "in"))  # a file stream reads a folder
    run(spark, "window", os.path.join(root, "in"), os.path.join(root, "wstream"), stream=True,
        checkpoint=os.path.join(root, "ck"), synthetic_clock=True)
    want = P.window(events_as_inbound(spark.read.parquet(ev)), synthetic()).count()
    assert spark.read.parquet(os.path.join(root, "wstream")).count() == want


def test_recovery_after_killed_process(spark):
    import subprocess
    import time

    root = tempfile.mkdtemp(prefix="hopline-kill-")
    ev, chunks, _ = _chunks(spark, root, parts=6)
    src, out, ckpt = os.path.join(root, "in"), os.path.join(root, "out"), os.path.join(root, "ckpt")
    os.makedirs(src)
    for i, c in enumerate(chunks):
        for f in sorted(os.listdir(c)):
            if f.endswith(".parquet"):
                os.link(os.path.join(c, f), os.path.join(src, f"part{i}-{f}"))
    worker = os.path.join(os.path.dirname(os.path.abspath(__file__)), "stream_worker.py")
    proc = subprocess.Popen([sys.executable, worker, src, out, ckpt, f"{SF_SMALL}/events.parquet"],
                            stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        deadline = time.time() + 240
        while time.time() < deadline and not os.path.exists(os.path.join(ckpt, "commits", "1")):
            time.sleep(0.5)
        assert os.path.exists(os.path.join(ckpt, "commits", "1")), "worker made no progress"
    finally:
        proc.kill()  # SIGKILL: no clean shutdown, possibly mid-batch
        proc.wait(60)
    _run(spark, S.window_stream, src, out, ckpt)  # resume from the checkpoint in this process
    got = spark.read.parquet(out)
    want = P.window(events_as_inbound(ev), synthetic())
    assert _rows(got) == _rows(want)


"""Streaming forms of the pipelines.

Stateless pipelines (basic, f2f, multi) and the receiver run unchanged on a
streaming DataFrame. Windowed pipelines cut each micro-batch in count windows (``streaming.count_window``) and finish the full
ones with the batch operators inside ``foreachBatch``. Time windows and reports keep their state the same way: a table of
one batch, committed under the checkpoint folder, from which the next batch starts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.operators import fanout, messages, metrics, validate, windows
from hopline.operators.ranking import arrival_rank
from hopline.plans import pipelines as P
from hopline.plans.topology import Routed, Topology
from hopline.operators.messages import kafka_sink_frame, kafka_sink_options
from hopline.sources.kafka import OUTBOUND_TOPIC, spout
from hopline.session import cut_lineage, tables_of_a_step
from hopline.streaming.count_window import CountWindowed, stream_count_window
from hopline.streaming.event_time import close_windows
from hopline.streaming.sinks import write_points
from hopline.streaming.table import CommittedTable

WINDOWED = ("window", "fish", "all")  # pipelines with a count window

def window_stream(inbound: DataFrame, topo: Topology | None = None, n: int = 10, group_by: str = "tuple"):
    """T4 on a stream: returns (windowed rows stream, finish) where ``finish(batch_df)``
    gives the sender rows of one micro-batch."""
    topo = topo or Topology()
    s = spout(inbound, topo.component("TimerSpout"))
    wc = topo.component("WindowedPathBolt")
    sender = topo.component("SenderBolt")
    w = stream_count_window(s, wc, n)

    def finish(batch: DataFrame) -> DataFrame:
        out = windows.emit_one(batch, wc, n, create_path_msg=True, group_by=group_by, windowed=True)
        return messages.send_stage(out, sender)

    return w, finish


def all_stream(inbound: DataFrame, topo: Topology | None = None, copies: int = 20, n: int = 10):
    """T6 on a stream: fixed fan-out, the stateful count window, and a ``finish`` that picks
    one message per full window and sends it."""
    topo = topo or Topology()
    s = spout(inbound, topo.component("TimerSpout"))
    m = fanout.fanout_fixed(s, topo.component("MultiPathBolt"), copies, out_stream="Stream2")
    wc = topo.component("WindowedPathBolt")
    sender = topo.component("SenderBolt")
    w = stream_count_window(m, wc, n)

    def finish(batch: DataFrame) -> DataFrame:
        return messages.send_stage(windows.emit_one(batch, wc, n, out_stream="Stream3", windowed=True), sender)

    return w, finish


def emit_all_stream(inbound: DataFrame, topo: Topology | None = None, n: int = 10):
    """W2 on a stream: path bolt, the stateful count window, and a ``finish`` that re-emits every message of a full window."""
    return _after_path_bolt(inbound, topo, n, windows.emit_all)


def emit_by_spout_stream(inbound: DataFrame, topo: Topology | None = None, n: int = 10):
    """W3 on a stream: as W2, with one message for each spout task of a full window."""
    return _after_path_bolt(inbound, topo, n, windows.emit_by_spout)


def _after_path_bolt(inbound: DataFrame, topo: Topology | None, n: int, emit):
    topo = topo or Topology()
    s = spout(inbound, topo.component("TimerSpout"))
    p = messages.path_bolt(s, topo.component("PathBolt"))
    wc = topo.component("WindowedPathBolt")
    return stream_count_window(p, wc, n), lambda batch: emit(batch, wc, n, windowed=True)


def fish_stream(inbound: DataFrame, topo: Topology | None = None, n: int = 20):
    """T5 on a stream: the two-stream front half, the stateful count window over both
    streams, and a ``finish`` that join-splits and sends each batch's full windows."""
    topo = topo or Topology()
    s = spout(inbound, topo.component("TimerSpout"), num_streams=2)
    pb, pm = topo.component("PathBolt"), topo.component("PathMultiplier")
    front = P.fork_path_and_multiplier(s, Routed({"kafkaMessages0": pb, "kafkaMessages1": pm}), pm)
    js = topo.component("JoinSplitBolt")
    senders = Routed({"Stream3": topo.component("SenderBoltA"), "Stream4": topo.component("SenderBoltB")})
    w = stream_count_window(front, js, n)

    def finish(batch: DataFrame) -> DataFrame:
        return messages.send_stage(windows.join_split(batch, js, n, windowed=True), senders)

    return w, finish


def _finished(stream, batch: DataFrame, batch_id: int, finish: Callable[[DataFrame], DataFrame], checkpoint: str) -> DataFrame:
    """What a micro-batch gives: its full windows (for a count-windowed stream), finished."""
    return finish(stream.step(batch, batch_id, _state_dir(checkpoint)) if isinstance(stream, CountWindowed) else batch)


def _state_dir(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}/hopline-state"


def _start(stream, checkpoint: str, each: Callable[[DataFrame, int], None], trigger: dict):
    def step(batch: DataFrame, batch_id: int) -> None:
        with tables_of_a_step():
            each(batch, batch_id)

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


def run_to_table(stream, finish: Callable[[DataFrame], DataFrame], out_dir: str, checkpoint: str, **trigger):
    """Run a windowed stream, writing each batch's finished rows to the ``CommittedTable`` ``out_dir``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        CommittedTable(batch.sparkSession, out_dir).write(_finished(stream, batch, batch_id, finish, checkpoint), batch_id)

    return _start(stream, checkpoint, each, trigger)


def run_to_kafka(stream, finish: Callable[[DataFrame], DataFrame], servers: str, checkpoint: str,
                 topic: str = OUTBOUND_TOPIC, trigger: dict | None = None, **producer):
    """Run a windowed stream, sending each batch's finished rows to Kafka (at least once: a replayed batch is sent again)."""
    options = kafka_sink_options(servers, checkpoint, **producer)
    del options["checkpointLocation"]  # the stream's, not the batch writer's

    def each(batch: DataFrame, batch_id: int) -> None:
        kafka_sink_frame(_finished(stream, batch, batch_id, finish, checkpoint), topic).write.format("kafka").options(**options).save()

    return _start(stream, checkpoint, each, trigger or {})


def fish_time_to_table(inbound: DataFrame, out_dir: str, checkpoint: str, topo: Topology | None = None, window_ms: int = 2000,
                       delay_ms: int = 10_000, late_dir: str | None = None, to_rows: Callable[[DataFrame], DataFrame] | None = None, **trigger):
    """T5 with time windows (W6) on a stream: windows close ``delay_ms`` behind the latest arrival of earlier batches.

    Rows of closed windows are stored in ``late_dir`` (by default ``<out_dir>_late``) with a reason.
    """
    topo = topo or Topology()
    s = spout(inbound, topo.component("TimerSpout"), num_streams=2)
    pb, pm = topo.component("PathBolt"), topo.component("PathMultiplier")
    front = P.fork_path_and_multiplier(s, Routed({"kafkaMessages0": pb, "kafkaMessages1": pm}), pm)
    js = topo.component("JoinSplitBolt")
    senders = Routed({"Stream3": topo.component("SenderBoltA"), "Stream4": topo.component("SenderBoltB")})
    late = late_dir or out_dir.rstrip("/") + "_late"
    end = ((F.col("win") + 1) * window_ms).alias("_end")

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = windows.by_arrival_time(batch, js, window_ms)
        closed = close_windows(
            rows.select("*", end), batch_id, _state_dir(checkpoint), late, "_arr", "_end", delay_ms,
            lambda r: windows.split_partials(r, js).select("*", end), lambda p: windows.merged_partials(p).select("*", end))
        sent = messages.send_stage(windows.split_of_partials(closed, js, window_ms), senders)
        CommittedTable(batch.sparkSession, out_dir).write(to_rows(sent) if to_rows else sent, batch_id)

    return _start(front, checkpoint, each, trigger)


def pipeline_to_tables(name: str, inbound: DataFrame, out_dir: str, latency_dir: str, checkpoint: str, topo: Topology | None = None,
                       bucket_ms: int = 2000, delay_ms: int = 10_000, to_rows: Callable[[DataFrame], DataFrame] | None = None,
                       rank_options: dict | None = None, trigger: dict | None = None, **options):
    """Any of T1-T6 on a stream with its hop latencies (M6): two outputs of one pass over each micro-batch.

    Sender rows go to ``out_dir``. Every stage's transfer rows are reduced to (component, task, bucket) counts, sums and maxima, which
    merge over batches; buckets close ``delay_ms`` behind the latest receive time of earlier batches and go to ``latency_dir``. Transfers of a
    closed bucket are stored in ``<latency_dir>_late`` with a reason.
    """
    topo_of = (lambda: Topology(topo.lanes, topo.seed, topo.clock)) if topo else Topology
    keys = ["component", "task", "bucket_start_ms", "_end"]

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*keys).agg(F.sum("transfers").alias("transfers"), F.sum("sum_ms").alias("sum_ms"), F.max("max_ms").alias("max_ms"))

    def partial(rows: DataFrame) -> DataFrame:
        return merge(rows.select(*keys, F.lit(1).cast("bigint").alias("transfers"), F.col("transfer_ms").alias("sum_ms"), F.col("transfer_ms").alias("max_ms")))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, taps = batch.sparkSession, []

        def windowing(rows: DataFrame, comp, n: int, **rank_kw) -> DataFrame:
            windowed = CountWindowed(rows, comp, n, "shuffle", rank_kw)
            return cut_lineage(windowed.step(rows, batch_id, f"{_state_dir(checkpoint)}/{comp.name}"))

        own = options | (rank_options or {}) | ({"windowing": windowing} if name in WINDOWED else {})
        sent = P.PIPELINES[name](cut_lineage(batch), topo_of(), taps=taps, **own)
        CommittedTable(spark, out_dir).write(to_rows(sent) if to_rows else sent, batch_id)
        start = F.expr(f"recv_ms div {bucket_ms} * {bucket_ms}")
        rows = reduce(DataFrame.unionByName, taps).withColumn("bucket_start_ms", start).withColumn("_end", start + bucket_ms)
        closed = close_windows(rows, batch_id, f"{_state_dir(checkpoint)}/latency", latency_dir.rstrip("/") + "_late",
                               "recv_ms", "_end", delay_ms, partial, merge)
        CommittedTable(spark, latency_dir).write(closed.drop("_end").withColumn(
            "mean_ms", F.col("sum_ms").cast("double") / F.col("transfers").cast("double")), batch_id)

    return _start(inbound, checkpoint, each, trigger or {})


def receiver_stream(kafka_rows: DataFrame) -> DataFrame:
    """T7 on a stream: metric points of accepted messages (stateless)."""
    return P.receiver_points(kafka_rows)


def receiver_to_points(kafka_rows: DataFrame, out_dir: str, checkpoint: str, quarantine_dir: str | None = None,
                       keep_rejected: bool = True, **trigger):
    """T7 + O2: metric points, and the rejected rows with their reason in ``quarantine_dir`` (by default ``<out_dir>_rejected``).

    Each micro-batch is validated once and committed to both tables, idempotently. ``keep_rejected=False`` stores no rejected rows.
    """
    rejected_dir = quarantine_dir or out_dir.rstrip("/") + "_rejected"

    def each(batch: DataFrame, batch_id: int) -> None:
        validated = cut_lineage(batch)
        if keep_rejected:
            CommittedTable(batch.sparkSession, rejected_dir).write(validate.quarantined(validated), batch_id)
        write_points(metrics.metric_points(validate.accepted(validated)), out_dir, batch_id)

    return _start(P.receiver(kafka_rows), checkpoint, each, trigger)


def throughput_by_count_to_table(kafka_rows: DataFrame, out_dir: str, checkpoint: str, n: int = 500, group_col: str = "partition",
                                 order_cols=("kafka_ts", "offset"), rank_options: dict | None = None, **trigger):
    """M4 on a stream: a report for every (n + 1)-th accepted message of a Kafka partition, as the batch form gives them.

    The state is a row a partition: messages so far and the time at which the open report started. A micro-batch is ranked as a
    batch is, and the partition's messages so far are added to the ranks.
    """
    order = list(order_cols)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = CommittedTable(spark, f"{_state_dir(checkpoint)}/reports")
        before = state.read_before(batch_id)
        if before is None:
            before = spark.createDataFrame([], batch.select(group_col).schema.add("seen", "long").add("start_ms", "long"))
        ranked = arrival_rank(cut_lineage(batch.select(group_col, *order)), [group_col], order, **(rank_options or {}))
        ranked = cut_lineage(ranked.join(before.select(group_col, "seen"), group_col, "left").withColumn(
            "rn", F.col("rn") + F.coalesce("seen", F.lit(0).cast("bigint"))))
        opened = before.select(group_col, F.expr(f"seen div {n + 1} + 1").alias("report_no"), F.lit(None).cast("bigint").alias("end_ms"), "start_ms")
        marks = cut_lineage(metrics.count_marks(ranked, n, group_col, order[0]).unionByName(opened))
        seen = before.select(group_col, "seen").unionByName(ranked.select(group_col, F.col("rn").alias("seen"))).groupBy(group_col).agg(
            F.max("seen").alias("seen"))
        starts = marks.where("start_ms IS NOT NULL").groupBy(group_col).agg(F.max_by("start_ms", "report_no").alias("start_ms"))
        state.write(seen.join(starts, group_col), batch_id)
        state.forget_before(batch_id - 1)
        CommittedTable(spark, out_dir).write(metrics.count_reports(marks, n, group_col), batch_id)

    return _start(validate.accepted(P.receiver(kafka_rows)), checkpoint, each, trigger)


def throughput_by_time_to_table(kafka_rows: DataFrame, out_dir: str, checkpoint: str, bucket_ms: int = 2000, delay_ms: int = 10_000,
                                late_dir: str | None = None, **trigger):
    """M5 on a stream with nothing lost: buckets close ``delay_ms`` behind the latest record time of earlier batches, and messages
    of a closed bucket are stored in ``late_dir`` (by default ``<out_dir>_late``) with a reason."""
    late = late_dir or out_dir.rstrip("/") + "_late"
    keys = ["bucket_start_ms", "_end"]

    def each(batch: DataFrame, batch_id: int) -> None:
        start = F.expr(f"kafka_ts div {bucket_ms} * {bucket_ms}")
        rows = batch.withColumn("bucket_start_ms", start).withColumn("_end", F.col("bucket_start_ms") + bucket_ms)
        closed = close_windows(
            rows, batch_id, _state_dir(checkpoint), late, "kafka_ts", "_end", delay_ms,
            lambda r: r.groupBy(*keys).agg(F.count(F.lit(1)).alias("messages")),
            lambda p: p.groupBy(*keys).agg(F.sum("messages").alias("messages")))
        CommittedTable(batch.sparkSession, out_dir).write(closed.select("bucket_start_ms", "messages", (
            F.col("messages").cast("double") * F.lit(1000.0) / F.lit(float(bucket_ms))).alias("rate_mps")), batch_id)

    return _start(validate.accepted(P.receiver(kafka_rows)), checkpoint, each, trigger)


def throughput_by_time_stream(kafka_rows: DataFrame, bucket: str = "2 seconds", watermark: str = "10 seconds"):
    """M5 on a stream: accepted messages per record-time bucket, emitted once the
    watermark passes the bucket's end (append mode); later rows for a closed bucket
    are dropped by the watermark, as Structured Streaming defines."""
    from pyspark.sql import functions as F

    acc = validate.accepted(P.receiver(kafka_rows)).withColumn("_t", F.timestamp_millis("kafka_ts"))
    return (
        acc.withWatermark("_t", watermark)
        .groupBy(F.window("_t", bucket).alias("w"))
        .agg(F.count(F.lit(1)).alias("messages"))
        .select(
            F.unix_millis(F.col("w.start")).alias("bucket_start_ms"),
            "messages",
            (F.col("messages").cast("double") * 1000.0 / (F.unix_millis(F.col("w.end")) - F.unix_millis(F.col("w.start"))).cast(
                "double")).alias("rate_mps"),
        )
    )

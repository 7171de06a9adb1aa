"""Composed pipelines (T1-T8), registered by name.

Each takes Kafka-shaped inbound rows and returns the rows its sender stage
writes (``send_stage`` output: typed message, ``sink``, ``append_ms``). Use
``to_outbound`` for the Kafka shape and ``receiver`` for the analysis side.
Component names, window sizes and fan-out parameters are those of the
modelled topologies; every one is a keyword argument. ``taps``, a list, gets
each stage's transfer rows (M6): one for every tuple that the stage receives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.functions.draws import normal_multiplier, unit
from hopline.operators import fanout, messages, metrics, validate, windows
from hopline.operators.messages import BOOK_COLS, draw_key, receive, transfers, with_created_message
from hopline.plans.topology import Component, Routed, Topology
from hopline.schema import slice_of
from hopline.sources.kafka import results_rows, spout


def _tap(taps: list | None, rows: DataFrame, comp, grouping: str = "shuffle") -> None:
    if taps is not None:
        taps.append(transfers(rows, comp, grouping))


def _windows(rows: DataFrame, comp: Component, n: int, taps: list | None, windowing=windows.count_window, **rank_kw) -> DataFrame:
    """The count window of a windowed stage; all tuples of its full windows are received. Streams give a ``windowing`` of their own."""
    w = windowing(rows, comp, n, **rank_kw)
    if taps is not None:
        taps.append(windows.window_transfers(w, comp))
    return w


def basic(inbound: DataFrame, topo: Topology | None = None, taps: list | None = None) -> DataFrame:
    """Spout -> PathBolt -> SenderBolt (shuffle groupings)."""
    topo = topo or Topology()
    s = spout(inbound, topo.component("TimerSpout"))
    path, sender = topo.component("PathBolt"), topo.component("SenderBolt")
    p = messages.path_bolt(s, path)
    _tap(taps, s, path)
    _tap(taps, p, sender)
    return messages.send_stage(p, sender)


def f2f(inbound: DataFrame, topo: Topology | None = None, taps: list | None = None) -> DataFrame:
    """Spout -> PathBolt -> PathAdderBolt (by key) -> SenderBolt (by key)."""
    topo = topo or Topology()
    s = spout(inbound, topo.component("TimerSpout"))
    path, adder, sender = (topo.component(c) for c in ("PathBolt", "PathAdderBolt", "SenderBolt"))
    p = messages.path_bolt(s, path)
    a = messages.path_adder(p, adder, grouping="fields")
    _tap(taps, s, path)
    _tap(taps, p, adder, "fields")
    _tap(taps, a, sender, "fields")
    return messages.send_stage(a, sender, grouping="fields")


def multi(inbound: DataFrame, topo: Topology | None = None, copies: int = 10, taps: list | None = None) -> DataFrame:
    """Spout -> MultiPathBolt (fixed fan-out) -> SenderBolt."""
    topo = topo or Topology()
    s = spout(inbound, topo.component("TimerSpout"))
    fan, sender = topo.component("MultiPathBolt"), topo.component("SenderBolt")
    m = fanout.fanout_fixed(s, fan, copies)
    _tap(taps, s, fan)
    _tap(taps, m, sender)
    return messages.send_stage(m, sender)


def window(inbound: DataFrame, topo: Topology | None = None, n: int = 10, group_by: str = "tuple",
           taps: list | None = None, **rank_kw) -> DataFrame:
    """T4: spout -> WindowedPathBolt (count window, one random, builds the message) -> SenderBolt."""
    topo = topo or Topology()
    s = spout(inbound, topo.component("TimerSpout"))
    comp, sender = topo.component("WindowedPathBolt"), topo.component("SenderBolt")
    rows = _windows(s, comp, n, taps, **rank_kw)
    w = windows.emit_one(rows, comp, n, create_path_msg=True, group_by=group_by, windowed=True)
    _tap(taps, w, sender)
    return messages.send_stage(w, sender)


def fork_path_and_multiplier(s: DataFrame, routed: Routed, mult_comp, vmin=1, vmax=20, mean=10, std=1.0,
                             streams=("kafkaMessages0", "kafkaMessages1"), outs=("Stream1", "Stream2")) -> DataFrame:
    """Fish front half in one pass: stream 0 through a path bolt, stream 1 through a
    normal fan-out. Both branches are one projection plus one ``explode``."""
    d = with_created_message(receive(s, routed), routed)
    is_path = F.col("stream") == streams[0]
    d = d.withColumn("_u", unit(mult_comp.seed, mult_comp.name, "mult", F.col("row_id")))  # hashed once per row
    m = normal_multiplier(F.col("_u"), vmin, vmax, mean, std)
    d = fanout.with_copies(d, F.when(is_path, F.lit(1).cast("bigint")).otherwise(m))
    d = d.withColumn("row_id", F.when(is_path, F.col("row_id")).otherwise(fanout.copy_id()))
    return d.select(
        *BOOK_COLS[:3], F.when(is_path, F.lit(outs[0])).otherwise(F.lit(outs[1])).alias("stream"), "copy", "lane",
        F.col("_now").alias("timestamp"),
        draw_key(routed, F.col("row_id")).alias("key"),
        "entryMilliTimestamp", "messageID", "originTimestamp", "stormMilliLatencyMs", "path", *slice_of(d),
    )


def fish(inbound: DataFrame, topo: Topology | None = None, n: int = 20, vmin: int = 1, vmax: int = 20,
         mean: float = 10, std: float = 1.0, time_window_ms: int | None = None, taps: list | None = None,
         **rank_kw) -> DataFrame:
    """T5: spout on two streams; PathBolt and PathMultiplier; JoinSplitBolt (count
    window over both); the same tuple to SenderBoltA and SenderBoltB.

    ``time_window_ms`` switches the join-split to the 2 s time window (W6), which has no taps."""
    topo = topo or Topology()
    s = spout(inbound, topo.component("TimerSpout"), num_streams=2)
    pb, pm = topo.component("PathBolt"), topo.component("PathMultiplier")
    routed = Routed({"kafkaMessages0": pb, "kafkaMessages1": pm})
    front = fork_path_and_multiplier(s, routed, pm, vmin, vmax, mean, std)
    _tap(taps, s, routed)
    js = topo.component("JoinSplitBolt")
    if time_window_ms:
        j = windows.join_split_time(front, js, time_window_ms)
    else:
        j = windows.join_split(_windows(front, js, n, taps, **rank_kw), js, n, windowed=True)
    senders = Routed({"Stream3": topo.component("SenderBoltA"), "Stream4": topo.component("SenderBoltB")})
    _tap(taps, j, senders)
    return messages.send_stage(j, senders)


def all_in_one(inbound: DataFrame, topo: Topology | None = None, copies: int = 20, n: int = 10,
               taps: list | None = None, **rank_kw) -> DataFrame:
    """Spout -> MultiPathBolt (fixed fan-out) -> WindowedPathBolt (one random) -> SenderBolt."""
    topo = topo or Topology()
    s = spout(inbound, topo.component("TimerSpout"))
    fan, comp, sender = (topo.component(c) for c in ("MultiPathBolt", "WindowedPathBolt", "SenderBolt"))
    m = fanout.fanout_fixed(s, fan, copies, out_stream="Stream2")
    _tap(taps, s, fan)
    w = windows.emit_one(_windows(m, comp, n, taps, **rank_kw), comp, n, out_stream="Stream3", windowed=True)
    _tap(taps, w, sender)
    return messages.send_stage(w, sender)


PIPELINES = {"basic": basic, "f2f": f2f, "multi": multi, "window": window, "fish": fish, "all": all_in_one}


def transfer_rows(name: str, inbound: DataFrame, topo: Topology | None = None, **options) -> DataFrame:
    """M6: the transfer rows of every stage of a pipeline, one for each tuple received."""
    taps: list[DataFrame] = []
    PIPELINES[name](inbound, topo, taps=taps, **options)
    return reduce(DataFrame.unionByName, taps)


def receiver(kafka_rows: DataFrame) -> DataFrame:
    """Returned Kafka rows -> F1/F2 validated rows (accepted and quarantined)."""
    return validate.validate_payload(results_rows(kafka_rows))


def receiver_points(kafka_rows: DataFrame) -> DataFrame:
    """Metric points (M3) of the accepted messages."""
    return metrics.metric_points(validate.accepted(receiver(kafka_rows)))


def receiver_quarantine(kafka_rows: DataFrame) -> DataFrame:
    """The rejected messages with their reason and raw value."""
    return validate.quarantined(receiver(kafka_rows))


def round_trip(inbound: DataFrame, topo: Topology | None = None) -> DataFrame:
    """The fish pipeline's output analysed by the receiver.

    Needs a clock that knows the record time: with the wall clock only the broker does, so run the two sides by themselves.
    """
    topo = topo or Topology()
    if not topo.clock.knows_append_time:
        raise ValueError("a round trip without a broker needs a clock that gives the record time, e.g. SyntheticClock()")
    return receiver_points(messages.to_outbound(fish(inbound, topo)))

"""Path-message stages (P1, P2, P8-P10) and the outbound Kafka shape (O1 input).

A message row carries the path message as typed columns
(messageID, originTimestamp, stormMilliLatencyMs, path) plus the tuple fields
(timestamp, key, entryMilliTimestamp) and bookkeeping columns. JSON is written
only when rows leave for Kafka, so consecutive stages collapse into one
projection under Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.functions.draws import hash32, unit, weighted_key
from hopline.functions.paths import append_element, to_payload
from hopline.operators.lanes import lane_for
from hopline.plans.topology import Component, Routed, name_col
from hopline.schema import slice_of
from hopline.sources.kafka import OUTBOUND_TOPIC, TS_LOG_APPEND

# --- fixed values: the modelled sender waits for no acknowledgement and never retries ---
FIRE_AND_FORGET = {"acks": "0", "retries": 0}
# --- end of fixed values ---

BOOK_COLS = ["row_id", "event_id", "msg_ts", "stream", "copy", "lane"]


def transfer_row(comp: Component | Routed, lane: Column, now: Column, incoming_ts: Column) -> list[Column]:
    """M6: what a stage measures on one received tuple."""
    return [
        name_col(comp).alias("component"),
        comp.task(lane).alias("task"),
        now.cast("bigint").alias("recv_ms"),
        (now - incoming_ts).cast("bigint").alias("transfer_ms"),
    ]


def transfers(rows: DataFrame, comp: Component | Routed, grouping: str = "shuffle", field: str = "key") -> DataFrame:
    """M6 rows of a stage, one for each tuple that it receives, before it fans out or picks."""
    return receive(rows, comp, grouping, field).select(
        *transfer_row(comp, F.col("lane"), F.col("_now"), F.col("timestamp")))


def draw_key(comp: Component, row_id: Column) -> Column:
    """K1 for one emitted tuple of a component."""
    return weighted_key(unit(comp.seed, name_col(comp), "key", row_id))


def receive(df: DataFrame, comp: Component, grouping: str = "shuffle", field: str = "key") -> DataFrame:
    """Route rows to a task of ``comp`` and stamp ``now``."""
    df = df.withColumn("lane", lane_for(comp, grouping, field))
    return df.withColumn("_now", comp.clock.hop(F.col("timestamp"), F.col("row_id"), name_col(comp)))


def with_created_message(df: DataFrame, comp: Component) -> DataFrame:
    """Path message from a spout tuple: [spout element, own element], origin = messageTimestamp."""
    return df.select(
        *[c for c in df.columns if c not in ("uuid", "messageTimestamp", "path")],
        F.col("uuid").alias("messageID"),
        F.col("messageTimestamp").alias("originTimestamp"),
        F.lit(0.0).alias("stormMilliLatencyMs"),
        F.array(F.col("path"), comp.element(F.col("lane"))).alias("path"),
    )


def path_bolt(spout_rows: DataFrame, comp: Component, grouping: str = "shuffle",
              out_stream: str = "pathMessages") -> DataFrame:
    """Create the path message, draw a key, keep the entry time."""
    df = with_created_message(receive(spout_rows, comp, grouping), comp)
    return df.select(
        *BOOK_COLS[:3], F.lit(out_stream).alias("stream"), "copy", "lane",
        F.col("_now").alias("timestamp"),
        draw_key(comp, F.col("row_id")).alias("key"),
        "entryMilliTimestamp", "messageID", "originTimestamp", "stormMilliLatencyMs", "path", *slice_of(df),
    )


def path_adder(rows: DataFrame, comp: Component, grouping: str = "fields",
               out_stream: str = "pathAddedMessages") -> DataFrame:
    """Append own element and re-draw the key."""
    df = receive(rows, comp, grouping)
    return df.select(
        *BOOK_COLS[:3], F.lit(out_stream).alias("stream"), "copy", "lane",
        F.col("_now").alias("timestamp"),
        draw_key(comp, F.col("row_id")).alias("key"),
        "entryMilliTimestamp", "messageID", "originTimestamp", "stormMilliLatencyMs",
        append_element(F.col("path"), comp.element(F.col("lane"))).alias("path"), *slice_of(df),
    )


def send_stage(rows: DataFrame, comp: Component | Routed, grouping: str = "shuffle") -> DataFrame:
    """P10: append the sender element; latency = now - entry time, as double.

    ``comp`` may be a ``Routed`` set of senders, one per input stream.

    ``append_ms`` is the log-append time the broker will give the record
    (synthetic clock), or NULL under a wall clock.
    """
    df = receive(rows, comp, grouping)
    return df.select(
        *BOOK_COLS,
        F.col("_now").alias("timestamp"),
        "key", "entryMilliTimestamp", "messageID", "originTimestamp",
        (F.col("_now") - F.col("entryMilliTimestamp")).cast("double").alias("stormMilliLatencyMs"),
        append_element(F.col("path"), comp.element(F.col("lane"))).alias("path"),
        name_col(comp).alias("sink"),
        comp.clock.append(F.col("_now"), F.col("row_id")).alias("append_ms"),
    )


def payload(rows: DataFrame) -> Column:
    return to_payload(F.col("messageID"), F.col("originTimestamp"), F.col("stormMilliLatencyMs"), F.col("path"))


def to_outbound(sent: DataFrame, topic: str = OUTBOUND_TOPIC, partitions: int = 4, seed: int = 42,
                value: Column | None = None, timestamp_type: Column | None = None) -> DataFrame:
    """Kafka-shaped outbound rows (null key, JSON value) as the broker would store them.

    Offsets are assigned by the broker; rows built here carry -1. ``value`` and
    ``timestamp_type`` override the payload and record type (test fixtures).
    """
    return sent.select(
        F.lit(None).cast("binary").alias("key"),
        (payload(sent).cast("binary") if value is None else value).alias("value"),
        F.lit(topic).alias("topic"),
        (hash32(seed, topic, "partition", F.col("sink"), F.col("row_id")) % partitions).cast("int").alias("partition"),
        F.lit(-1).cast("bigint").alias("offset"),
        F.timestamp_millis(F.col("append_ms")).alias("timestamp"),
        (F.lit(TS_LOG_APPEND) if timestamp_type is None else timestamp_type).alias("timestampType"),
        "row_id",
        "sink",
    )


def kafka_sink_frame(sent: DataFrame, topic: str = OUTBOUND_TOPIC) -> DataFrame:
    """O1 input for ``write.format('kafka')``: null key, JSON value, topic column."""
    return sent.select(
        F.lit(None).cast("string").alias("key"),
        payload(sent).alias("value"),
        F.lit(topic).alias("topic"),
    )


def kafka_sink_options(servers: str, checkpoint: str, acks: str = "all", retries: int | None = None) -> dict[str, str]:
    """O1: producer settings of the sender stage.

    By default every record is acknowledged by all replicas and retried as the producer does by itself.
    ``**FIRE_AND_FORGET`` gives the modelled sender's settings, which may lose records.
    """
    return {
        "kafka.bootstrap.servers": servers,
        "kafka.acks": acks,
        **({} if retries is None else {"kafka.retries": str(retries)}),
        "checkpointLocation": checkpoint,
    }

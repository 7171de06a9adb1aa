"""Sources (S1-S5): Kafka-shaped ingest, spout stage, results source, message minting.

No Kafka connector jar ships with this environment, so the Kafka readers are
thin ``readStream.format('kafka')`` wrappers checked by option tests only; the
same downstream code runs on Kafka-shaped rows from parquet or a file stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.functions.draws import hash32, uuid_from
from hopline.operators.ranking import dealt_by_slice
from hopline.plans.topology import Component
from hopline.schema import slice_of

# --- fixed values: topic and stream names used by the modelled topologies ---
INBOUND_TOPIC = "beforeStorm"
OUTBOUND_TOPIC = "afterStorm"
SPOUT_STREAM_PREFIX = "kafkaMessages"
# --- end of fixed values ---

# Spark's Kafka source: -1 none, 0 create time, 1 log-append time
TS_NONE, TS_CREATE, TS_LOG_APPEND = -1, 0, 1


def mint_message_id(event_id: Column) -> Column:
    """The message id a generator would mint; deterministic per event."""
    return uuid_from(event_id)


def ntz_to_instant(ts: Column) -> Column:
    """A wall-clock ``timestamp_ntz`` read as UTC, independent of the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, ts))


#: What one task gets of a source before a 10-20x fan-out: some ten thousand messages, a few hundred thousand copies.
BYTES_PER_TASK = 1 << 16
MOST_TASKS = 1 << 15
SLICE_MESSAGES = 1 << 13  # of a source that is dealt by slices of its order
UNKNOWN_BYTES = 1 << 60  # plans without a size say so by a huge one


def source_tasks(df: DataFrame, bytes_per_task: int = BYTES_PER_TASK) -> int:
    """Tasks for a batch source by the size that its plan states (files: their bytes), whatever the cluster's cores; 1 if it states none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 if size >= UNKNOWN_BYTES else min(MOST_TASKS, -(-size // bytes_per_task))


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Hash-spread a batch source over ``partitions``, by default over ``source_tasks``; a source for one task stays as it is.

    A few large row groups are a few tasks of a scan, and the 10-20x fan-out behind it would run in those alone.
    """
    if df.isStreaming:
        return df
    n = source_tasks(df) if partitions is None else partitions
    return df if n <= 1 else df.repartition(n, key)


def spread_by_time(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """``spread`` for windows: the messages of a slice of the arrival order go to one task, so that what windows keep together lies together
    before it is fanned out."""
    n = 1 if events.isStreaming else source_tasks(events) if partitions is None else partitions
    if n <= 1:
        return events
    timed = events.withColumns({"msg_ts": F.unix_millis(ntz_to_instant(F.col("ts"))), "event_id": F.col("event_id").cast("bigint")})
    return dealt_by_slice(timed, ["msg_ts", "event_id"], n, SLICE_MESSAGES)


def events_as_inbound(events: DataFrame, topic: str = INBOUND_TOPIC, partitions: int | None = None, by_time: bool = False) -> DataFrame:
    """Kafka-shaped inbound rows from the ``events`` table (one message per event).

    ``row_id`` and ``event_id`` ride along as the stable identity of each message, with ``by_time`` (for windows) also its slice.
    """
    events = events.select("event_id", "ts")
    events = spread_by_time(events, partitions) if by_time else spread(events, "event_id", partitions)
    return events.select(
        F.lit(None).cast("binary").alias("key"),
        mint_message_id(F.col("event_id")).cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").cast("bigint").alias("offset"),
        ntz_to_instant(F.col("ts")).alias("timestamp"),
        F.lit(TS_CREATE).alias("timestampType"),
        F.col("event_id").cast("string").alias("row_id"),
        F.col("event_id").cast("bigint").alias("event_id"),
        *slice_of(events),
    )


def spout(inbound: DataFrame, comp: Component, out_stream: str = SPOUT_STREAM_PREFIX, num_streams: int = 1) -> DataFrame:
    """S1 (+ S3): Kafka rows -> spout tuples, emitted on ``out_stream0..n-1``.

    The record value becomes ``uuid`` and its timestamp ``messageTimestamp``; the
    spout stamps entry time and the first path element. Several output streams
    come from one scan via ``explode``, never a self-union.
    """
    cols = set(inbound.columns)
    row_id = F.col("row_id") if "row_id" in cols else F.concat_ws(
        "/", F.col("topic"), F.col("partition").cast("string"), F.col("offset").cast("string")
    )
    event_id = F.col("event_id") if "event_id" in cols else F.col("offset")
    df = inbound.select(
        row_id.alias("row_id"),
        event_id.cast("bigint").alias("event_id"),
        F.col("value").cast("string").alias("uuid"),
        F.unix_millis(F.col("timestamp")).alias("messageTimestamp"),
        *slice_of(inbound),
    )
    lane = hash32(comp.seed, comp.name, "lane", F.col("row_id")) % comp.lanes
    entry = comp.clock.entry(F.col("row_id"), F.col("messageTimestamp"))
    streams = [F.lit(f"{out_stream}{i}") for i in range(num_streams)]
    stream = streams[0] if num_streams == 1 else F.explode(F.array(*streams))
    return df.select(
        "row_id",
        "event_id",
        F.col("messageTimestamp").alias("msg_ts"),
        stream.alias("stream"),
        F.lit(0).cast("bigint").alias("copy"),
        lane.alias("lane"),
        entry.alias("timestamp"),
        "uuid",
        entry.alias("entryMilliTimestamp"),
        "messageTimestamp",
        comp.element(lane).alias("path"),
        *slice_of(df),
    )


def kafka_source_options(servers: str, topic: str, group_id: str, max_per_trigger: int | None = None,
                         starting: str = "latest", fail_on_data_loss: bool = True) -> dict[str, str]:
    """Options for ``readStream.format('kafka')`` mirroring the spout's consumer.

    Offsets live in the query checkpoint; the group id only names the consumer. Offsets that the broker
    no longer has stop the query, unless ``fail_on_data_loss`` is false: then they are skipped and their rows are lost.
    """
    opts = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "kafka.group.id": group_id,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
        "includeHeaders": "false",
    }
    if max_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return opts


def read_kafka_stream(spark, servers: str, topic: str, group_id: str, **kw) -> DataFrame:
    """S1/S4 live source. Needs the spark-sql-kafka package on the classpath."""
    reader = spark.readStream.format("kafka")
    for k, v in kafka_source_options(servers, topic, group_id, **kw).items():
        reader = reader.option(k, v)
    return reader.load()


def results_rows(kafka_rows: DataFrame) -> DataFrame:
    """Returned messages as receiver input (value text, record time in ms, its type)."""
    cols = set(kafka_rows.columns)
    extra = [c for c in ("row_id", "sink") if c in cols]
    return kafka_rows.select(
        F.col("value").cast("string").alias("value"),
        F.unix_millis(F.col("timestamp")).alias("kafka_ts"),
        F.col("timestampType").cast("int").alias("timestampType"),
        F.col("partition").cast("int").alias("partition"),
        F.col("offset").cast("bigint").alias("offset"),
        *extra,
    )

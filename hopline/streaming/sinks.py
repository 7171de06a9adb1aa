"""Sinks (O1-O3) for streaming queries.

O2 writes each micro-batch's metric points as parquet partitioned by measurement to a ``CommittedTable``: a batch is
visible whole or not at all, and a replayed batch replaces its first attempt. ``read_points`` reads what is committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from hopline.operators.messages import kafka_sink_frame, kafka_sink_options
from hopline.sources.kafka import OUTBOUND_TOPIC
from hopline.streaming.table import CommittedTable


def write_points(points: DataFrame, out_dir: str, batch_id: int) -> None:
    """O2 for one micro-batch."""
    CommittedTable(points.sparkSession, out_dir).write(points, batch_id, "measurement")


def read_points(spark, out_dir: str) -> DataFrame | None:
    """The committed metric points; None before the first commit."""
    return CommittedTable(spark, out_dir).read()


def metric_sink(points_stream: DataFrame, out_dir: str, checkpoint: str, **trigger):
    """O2: stream metric points to a partitioned parquet table, one folder per batch."""
    w = points_stream.writeStream.foreachBatch(lambda df, bid: write_points(df, out_dir, bid)).option(
        "checkpointLocation", checkpoint
    )
    return (w.trigger(**trigger) if trigger else w).start()


def console_sink(stream: DataFrame, **trigger):
    """O3: print path messages (debugging)."""
    w = stream.writeStream.format("console").option("truncate", "false")
    return (w.trigger(**trigger) if trigger else w).start()


def kafka_sink(sent_stream: DataFrame, servers: str, checkpoint: str, topic: str = OUTBOUND_TOPIC, **producer):
    """O1: JSON payloads to Kafka with the sender's producer settings (needs the Kafka connector)."""
    w = kafka_sink_frame(sent_stream, topic).writeStream.format("kafka")
    for k, v in kafka_sink_options(servers, checkpoint, **producer).items():
        w = w.option(k, v)
    return w.start()

"""Run a pipeline by name.

    python -m hopline.run <name> --input <parquet> --output <dir>
    spark-submit --py-files hopline.zip hopline/run.py <name> --input ... --output ...

    basic | f2f | multi | window | fish | all     sender rows (Kafka-shaped parquet, JSON value)
    receiver                                       metric points of Kafka-shaped input rows
    throughput                                     the receiver's count report of Kafka-shaped input rows
    round_trip                                     fish, then the receiver's metric points

``--kafka-servers`` reads the topic named by ``--input`` instead, with bounded micro-batches, and ``--to-kafka`` sends
sender rows to the topic named by ``--output`` (both need the Kafka connector on the classpath).

``--input`` holds either ``events``-shaped rows (event_id, ts) or Kafka-shaped rows
(key, value, topic, partition, offset, timestamp, timestampType). ``--stream`` reads the
input folder (a folder, not a single file) as a file stream until it is exhausted
(``availableNow``); windowed pipelines keep their count-window state in ``--checkpoint``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from hopline.functions.clock import SyntheticClock, WallClock
from hopline.operators import metrics, validate
from hopline.operators.messages import to_outbound
from hopline.plans import pipelines as P
from hopline.plans.topology import Topology
from hopline.session import cut_lineage
from hopline.sources.kafka import events_as_inbound, read_kafka_stream
from hopline.streaming import pipelines as S
from hopline.streaming.sinks import kafka_sink

WINDOWED_STREAMS = {"window": S.window_stream, "fish": S.fish_stream, "all": S.all_stream}


def _inbound(df: DataFrame, spread: int | None = None) -> DataFrame:
    return events_as_inbound(df, partitions=spread) if {"event_id", "ts"} <= set(df.columns) else df


def run(spark: SparkSession, name: str, input_path: str, output: str, stream: bool = False,
        checkpoint: str | None = None, synthetic_clock: bool = False, lanes: int = 16, seed: int = 42,
        quarantine: str | None = None, files_per_trigger: int = 8, spread: int | None = None,
        kafka_servers: str | None = None, kafka_group: str = "hopline", offsets_per_trigger: int = 100_000,
        to_kafka: bool = False, keep_rejected: bool = True, time_window_ms: int | None = None,
        latency: str | None = None) -> None:
    quarantine = quarantine or output.rstrip("/") + "_rejected"
    if latency and (not stream or to_kafka or time_window_ms or name not in P.PIPELINES):
        raise SystemExit("--latency is for a stream of a pipeline with a sender, written to a table")
    if time_window_ms and (name != "fish" or to_kafka):
        raise SystemExit("--time-window is for fish, written to a table")
    topo = Topology(lanes=lanes, seed=seed, clock=SyntheticClock() if synthetic_clock else WallClock())
    if not stream:
        src = _inbound(spark.read.parquet(input_path), spread)
        if name == "receiver":
            validated = cut_lineage(P.receiver(src))  # validated once, then split
            if keep_rejected:
                validate.quarantined(validated).write.mode("overwrite").parquet(quarantine)
            out = metrics.metric_points(validate.accepted(validated))
        elif name == "throughput":
            out = metrics.throughput_by_count(validate.accepted(P.receiver(src)))
        elif name == "round_trip":
            out = P.round_trip(src, topo)
        else:
            options = {"time_window_ms": time_window_ms} if time_window_ms else {}
            out = to_outbound(P.PIPELINES[name](src, topo, **options))
        out.write.mode("overwrite").parquet(output)
        return
    if to_kafka and (not kafka_servers or name == "receiver"):
        raise SystemExit("--to-kafka needs --kafka-servers and a pipeline with a sender")
    if not checkpoint:
        raise SystemExit("--checkpoint is required with --stream")
    if kafka_servers:
        src = read_kafka_stream(spark, kafka_servers, input_path, kafka_group, max_per_trigger=offsets_per_trigger)
    else:
        schema = spark.read.parquet(input_path).schema
        src = _inbound(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(input_path))
    trigger = {} if kafka_servers else {"availableNow": True}  # a file stream ends with its input, a Kafka stream goes on
    if name == "receiver":
        q = S.receiver_to_points(src, output, checkpoint, quarantine, keep_rejected, **trigger)
    elif latency:
        q = S.pipeline_to_tables(name, src, output, latency, checkpoint, topo, to_rows=to_outbound, trigger=trigger)
    elif name == "throughput":
        q = S.throughput_by_count_to_table(src, output, checkpoint, **trigger)
    elif time_window_ms:
        q = S.fish_time_to_table(src, output, checkpoint, topo, time_window_ms, to_rows=to_outbound, **trigger)
    elif name in WINDOWED_STREAMS:
        w, finish = WINDOWED_STREAMS[name](src, topo)
        if to_kafka:
            q = S.run_to_kafka(w, finish, kafka_servers, checkpoint, output, trigger)
        else:
            q = S.run_to_table(w, lambda b: to_outbound(finish(b)), output, checkpoint, **trigger)
    elif name in P.PIPELINES and to_kafka:
        q = kafka_sink(P.PIPELINES[name](src, topo), kafka_servers, checkpoint, output)
    elif name in P.PIPELINES:
        out = to_outbound(P.PIPELINES[name](src, topo))
        w = out.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
        q = (w.trigger(**trigger) if trigger else w).start()
    else:
        raise SystemExit(f"no streaming form for {name!r}")
    q.awaitTermination()


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="hopline.run")
    ap.add_argument("name", choices=sorted(list(P.PIPELINES) + ["receiver", "round_trip", "throughput"]))
    ap.add_argument("--input", required=True)
    ap.add_argument("--output", required=True)
    ap.add_argument("--stream", action="store_true")
    ap.add_argument("--checkpoint")
    ap.add_argument("--synthetic-clock", action="store_true", help="stamp reproducible times instead of the wall clock's (round_trip needs it)")
    ap.add_argument("--kafka-servers", help="stream from Kafka: --input is then the topic")
    ap.add_argument("--kafka-group", default="hopline")
    ap.add_argument("--offsets-per-trigger", type=int, default=100_000, help="bound of a micro-batch of a Kafka stream")
    ap.add_argument("--to-kafka", action="store_true", help="send to Kafka: --output is then the topic")
    ap.add_argument("--quarantine", help="receiver: folder for the rejected rows with reason and raw value (default: <output>_rejected)")
    ap.add_argument("--drop-rejected", action="store_true", help="receiver: store no rejected rows")
    ap.add_argument("--files-per-trigger", type=int, default=8, help="bound of a micro-batch of a file stream")
    ap.add_argument("--spread", type=int, help="spread a batch of few large files over so many partitions")
    ap.add_argument("--time-window", type=int, help="fish: join-split over time windows of so many ms instead of counts")
    ap.add_argument("--latency", help="stream: folder for the hop latencies of every stage, per task and two seconds")
    ap.add_argument("--lanes", type=int, default=16)
    ap.add_argument("--seed", type=int, default=42)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"hopline-{a.name}").getOrCreate()
    run(spark, a.name, a.input, a.output, a.stream, a.checkpoint, a.synthetic_clock, a.lanes, a.seed,
        a.quarantine, a.files_per_trigger, a.spread, a.kafka_servers, a.kafka_group, a.offsets_per_trigger, a.to_kafka,
        not a.drop_rejected, a.time_window, a.latency)


if __name__ == "__main__":
    main()

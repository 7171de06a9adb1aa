"""Latency and throughput metrics (M1-M6) and the draw distributions (K2, K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from hopline.functions.draws import KEY_WEIGHTS, KEYS
from hopline.functions.paths import path_string
from hopline.operators.ranking import arrival_rank
from hopline.session import cut_lineage

# --- fixed values: measurement names written by the receiver ---
KAFKA_LATENCY = "measured-kafka-latency"
END2END_LATENCY = "measured-end2end-latency"
# --- end of fixed values ---


def kafka_latency(acc: DataFrame) -> DataFrame:
    """M1: record (log-append) time minus originTimestamp; tagged by spout endpoint."""
    return acc.select(
        F.lit(KAFKA_LATENCY).alias("measurement"),
        "spout_component",
        "spout_task",
        (F.col("kafka_ts") - F.col("originTimestamp")).alias("value"),
        path_string(F.col("path"), ">").alias("path"),
    )


def end2end_latency(acc: DataFrame) -> DataFrame:
    """M2: the pipeline's own latency field; tagged by spout and sink endpoints."""
    return acc.select(
        F.lit(END2END_LATENCY).alias("measurement"),
        "spout_component",
        "spout_task",
        "sink_component",
        "sink_task",
        F.col("stormMilliLatencyMs").alias("ms_latency_ms"),
        path_string(F.col("path"), ">").alias("path"),
    )


def metric_points(acc: DataFrame) -> DataFrame:
    """M3: two points per accepted message, long form, from one pass."""
    ps = path_string(F.col("path"), ">")
    kafka = F.struct(
        F.lit(KAFKA_LATENCY).alias("measurement"),
        F.lit(None).cast("string").alias("sink_component"),
        F.lit(None).cast("bigint").alias("sink_task"),
        (F.col("kafka_ts") - F.col("originTimestamp")).alias("value"),
        F.lit(None).cast("double").alias("ms_latency_ms"),
    )
    e2e = F.struct(
        F.lit(END2END_LATENCY).alias("measurement"),
        F.col("sink_component").alias("sink_component"),
        F.col("sink_task").alias("sink_task"),
        F.lit(None).cast("bigint").alias("value"),
        F.col("stormMilliLatencyMs").alias("ms_latency_ms"),
    )
    return acc.select("spout_component", "spout_task", ps.alias("path"), F.explode(F.array(kafka, e2e)).alias("m")).select(
        "m.measurement", "spout_component", "spout_task", "m.sink_component", "m.sink_task", "m.value",
        "m.ms_latency_ms", "path",
    )


def metric_tags_fields(points: DataFrame) -> DataFrame:
    """M3 in the tags/fields form of a time-series point (maps of strings)."""
    tags = F.map_filter(
        F.create_map(
            F.lit("spout_component"), F.col("spout_component"),
            F.lit("spout_task"), F.col("spout_task").cast("string"),
            F.lit("sink_component"), F.col("sink_component"),
            F.lit("sink_task"), F.col("sink_task").cast("string"),
        ),
        lambda k, v: v.isNotNull(),
    )
    fields = F.map_filter(
        F.create_map(
            F.lit("value"), F.col("value").cast("string"),
            F.lit("ms_latency_ms"), F.col("ms_latency_ms").cast("string"),
            F.lit("path"), F.col("path"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return points.select("measurement", tags.alias("tags"), fields.alias("fields"))


def throughput_by_count(acc: DataFrame, n: int = 500, group_col: str = "partition",
                        order_cols=("kafka_ts", "offset"), **rank_kw) -> DataFrame:
    """M4: the receiver's count-based rate report, per Kafka partition.

    The receiver's counter resets on the message after the N-th without counting
    it, so a report fires on every (N + 1)-th accepted message and says N. The
    elapsed time runs from the previous report (from the first message, for the
    first report). Only partition and order columns are written and ranked, so what comes before runs once,
    and the ranking scales past one task per partition.
    """
    order_cols = list(order_cols)
    r = arrival_rank(cut_lineage(acc.select(group_col, *order_cols)), [group_col], order_cols, **rank_kw)
    return count_reports(count_marks(r, n, group_col, order_cols[0]), n, group_col)


def count_marks(ranked: DataFrame, n: int, group_col: str, time_col: str) -> DataFrame:
    """(group, report_no, end_ms, start_ms): where reports end and start, from rows ranked ``rn`` in their group."""
    every = n + 1
    at, last = F.col(time_col), F.expr(f"rn div {every}")
    # message j * (N + 1) ends report j and starts report j + 1; the first message starts report 1
    ends = F.struct(last.alias("report_no"), at.alias("end_ms"), F.lit(None).cast("bigint").alias("start_ms"))
    starts = F.struct((last + 1).alias("report_no"), F.lit(None).cast("bigint").alias("end_ms"), at.alias("start_ms"))
    is_end = F.col("rn") % every == 0
    return ranked.where((F.col("rn") == 1) | is_end).select(
        group_col, F.inline(F.when(is_end, F.array(ends, starts)).otherwise(F.array(starts))))


def count_reports(marks: DataFrame, n: int, group_col: str) -> DataFrame:
    """M4 rows of the reports whose end is among ``marks``."""
    rep = marks.groupBy(group_col, "report_no").agg(F.max("end_ms").alias("end_ms"), F.max("start_ms").alias("start_ms"))
    elapsed = F.col("end_ms") - F.col("start_ms")
    return rep.where(F.col("end_ms").isNotNull()).select(
        F.col(group_col),
        F.col("report_no").cast("bigint").alias("report_no"),
        F.lit(n).cast("bigint").alias("messages"),
        F.col("start_ms").cast("bigint").alias("start_ms"),
        F.col("end_ms").cast("bigint").alias("end_ms"),
        elapsed.cast("bigint").alias("elapsed_ms"),
        F.when(elapsed > 0, F.lit(float(n)) * F.lit(1000.0) / elapsed.cast("double")).alias("rate_mps"),
    )


def throughput_by_time(acc: DataFrame, bucket_ms: int = 2000, time_col: str = "kafka_ts") -> DataFrame:
    """M5: accepted messages per time bucket and their rate (the form that scales)."""
    b = F.expr(f"`{time_col}` div {bucket_ms} * {bucket_ms}")
    return acc.groupBy(b.alias("bucket_start_ms")).agg(F.count(F.lit(1)).alias("messages")).withColumn(
        "rate_mps", F.col("messages").cast("double") * F.lit(1000.0) / F.lit(float(bucket_ms))
    )


def transfer_latency(transfers: DataFrame, bucket_ms: int = 2000) -> DataFrame:
    """M6: hop transfer latency (receive time minus upstream emit time), per task and bucket.

    ``transfers`` has a row for every tuple received (``plans.pipelines.transfer_rows``).
    """
    g = transfers.groupBy(
        "component", "task", F.expr(f"recv_ms div {bucket_ms} * {bucket_ms}").alias("bucket_start_ms")
    ).agg(F.count(F.lit(1)).alias("transfers"), F.sum("transfer_ms").alias("sum_ms"), F.max("transfer_ms").alias("max_ms"))
    return g.withColumn("mean_ms", F.col("sum_ms").cast("double") / F.col("transfers").cast("double"))


def key_weights(spark) -> DataFrame:
    """The expected key weights as a 16-row table (fixed size)."""
    schema = StructType([StructField("key", StringType()), StructField("weight", DoubleType())])
    return spark.createDataFrame(list(zip(KEYS, KEY_WEIGHTS)), schema)


def key_distribution(rows: DataFrame) -> DataFrame:
    """K2: observed key counts and shares against the expected weights."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("observed"))
    weights = F.broadcast(key_weights(rows.sparkSession))  # 16 rows
    return weights.join(counts, "key", "left").select(
        "key", "weight",
        F.coalesce(F.col("observed"), F.lit(0)).cast("bigint").alias("observed"),
    ).withColumn("share", F.col("observed").cast("double") / F.sum("observed").over(Window.partitionBy()).cast("double"))


def multiplier_distribution(rows: DataFrame, col: str = "multiplier") -> DataFrame:
    """K4: observed counts per drawn multiplier value."""
    counts = rows.groupBy(F.col(col).alias("multiplier")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows").cast("double") / F.sum("rows").over(Window.partitionBy()).cast("double"))

"""Receiver validation (F1-F3): keep bad records as data with a reason.

``reject_reason`` is NULL for accepted rows. The first failing check wins, in
the receiver's own order: record timestamp type, then the payload as it is
decoded (JSON, originTimestamp, stormMilliLatencyMs, path, endpoints, task ids).
Every path element must be a string; only the first and last must be endpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.functions.paths import json_object, json_values, payload_fields, strings_only
from hopline.sources.kafka import TS_LOG_APPEND, TS_NONE

# --- fixed values: reject reasons, in evaluation order ---
NO_TIMESTAMP = "no_timestamp"
NOT_LOG_APPEND = "not_log_append"
NULL_VALUE = "null_value"
BAD_JSON = "bad_json"
MISSING_ORIGIN = "missing_origin"
MISSING_LATENCY = "missing_latency"
MISSING_PATH = "missing_path"
EMPTY_PATH = "empty_path"
BAD_ELEMENT = "bad_element"
BAD_ENDPOINT = "bad_endpoint"
NON_INTEGER_TASK = "non_integer_task"
# --- end of fixed values ---


def timestamp_type_reason(df: DataFrame) -> DataFrame:
    """reject a missing record timestamp or type, then anything that is not log-append time."""
    t = F.col("timestampType")
    return df.withColumn(
        "reject_reason",
        F.when(t.isNull() | (t == TS_NONE) | F.col("kafka_ts").isNull(), F.lit(NO_TIMESTAMP))
        .when(t != TS_LOG_APPEND, F.lit(NOT_LOG_APPEND)),
    )


def validate_payload(df: DataFrame) -> DataFrame:
    """F1 + F2: add ``reject_reason`` and the typed payload fields with endpoints.

    The payload is parsed once, to a variant; types, fields and the path are read from that. The outcome leaves
    through a one-row ``inline`` so that a later filter on ``reject_reason`` stays above the parse instead
    of being pushed down with the parse (and everything before it) inlined.
    """
    df = timestamp_type_reason(df).withColumnRenamed("reject_reason", "_f1")
    d = df.withColumn("_all", json_values(F.col("value"))).withColumn("_v", json_object(F.col("_all"))).withColumn(
        "_p", payload_fields(F.col("_v")))
    d = d.withColumn("_first", F.split(F.try_element_at(F.col("_p.path"), F.lit(1)), ":", -1)).withColumn(
        "_last", F.split(F.try_element_at(F.col("_p.path"), F.lit(-1)), ":", -1)
    )
    spout_task = F.try_element_at(F.col("_first"), F.lit(2)).try_cast("bigint")
    sink_task = F.try_element_at(F.col("_last"), F.lit(2)).try_cast("bigint")
    path = F.col("_p.path")
    reason = (
        F.when(F.col("_f1").isNotNull(), F.col("_f1"))
        .when(F.col("value").isNull(), F.lit(NULL_VALUE))
        .when(F.col("_v").isNull(), F.lit(BAD_JSON))
        .when(F.col("_p.originTimestamp").isNull(), F.lit(MISSING_ORIGIN))
        .when(F.col("_p.stormMilliLatencyMs").isNull(), F.lit(MISSING_LATENCY))
        .when(path.isNull(), F.lit(MISSING_PATH))
        .when(F.size(path) == 0, F.lit(EMPTY_PATH))
        .when(~strings_only(F.col("_v")) | F.exists(path, lambda x: x.isNull()), F.lit(BAD_ELEMENT))
        .when((F.size("_first") != 2) | (F.size("_last") != 2), F.lit(BAD_ENDPOINT))
        .when(spout_task.isNull() | sink_task.isNull(), F.lit(NON_INTEGER_TASK))
    )
    outcome = F.struct(
        F.col("_p.messageID").alias("messageID"),
        F.col("_p.originTimestamp").alias("originTimestamp"),
        F.col("_p.stormMilliLatencyMs").alias("stormMilliLatencyMs"),
        path.alias("path"),
        F.try_element_at(F.col("_first"), F.lit(1)).alias("spout_component"),
        spout_task.alias("spout_task"),
        F.try_element_at(F.col("_last"), F.lit(1)).alias("sink_component"),
        sink_task.alias("sink_task"),
        reason.alias("reject_reason"),
    )
    keep = [c for c in df.columns if c != "_f1"]
    return d.select(*keep, F.inline(F.array(outcome)))


def accepted(validated: DataFrame) -> DataFrame:
    """the accepted side."""
    return validated.where(F.col("reject_reason").isNull())


def quarantined(validated: DataFrame) -> DataFrame:
    """the quarantine side, raw value kept for inspection."""
    return validated.where(F.col("reject_reason").isNotNull())


def reject_counts(validated: DataFrame) -> DataFrame:
    """rows per outcome (``accepted`` for NULL reason), one aggregation pass."""
    return validated.groupBy(F.coalesce(F.col("reject_reason"), F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("rows")
    )

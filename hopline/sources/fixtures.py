"""Deterministic test inputs derived from the provided tables.

* ``events`` becomes Kafka-shaped inbound messages (one per event).
* The receiver rejection fixture corrupts returned messages by a hashed case
  number so that every reject reason occurs on whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.functions.draws import hash32
from hopline.functions.paths import to_json_fields
from hopline.operators.messages import to_outbound
from hopline.sources.kafka import TS_CREATE, TS_LOG_APPEND, TS_NONE, events_as_inbound  # noqa: F401


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def inbound_from(spark, sf_dir: str, by_time: bool = False) -> DataFrame:
    return events_as_inbound(read_table(spark, sf_dir, "events"), by_time=by_time)


def _path_with(path: Column, first: Column | None = None, last: Column | None = None) -> Column:
    n = F.size(path)
    if first is not None:
        return F.concat(F.array(first), F.slice(path, 2, n - 1))
    return F.concat(F.slice(path, 1, n - 1), F.array(last))


def corrupt_payload(sent: DataFrame, cases: int = 25, tstype_cases: int = 20) -> DataFrame:
    """Outbound rows with some payloads and record timestamp types spoiled.

    Case ``H(row_id, 'bad') % 25``: 0 ``{bad``; 1-3 drop originTimestamp,
    stormMilliLatencyMs, path; 4 empty path; 5 first element ``A:1:2``;
    6 last element ``B``; 7 first element ``A:x``; 8 NULL; 9 empty text;
    10 middle element ``junk`` (still accepted); 11 one-element path (accepted);
    12 text after the object; 13 two objects; 14 single quotes; 15 null and 16 numeric middle element;
    otherwise unchanged. Type ``H(row_id, 'tstype') % 20``: 0 none, 1 create time, 2 NULL,
    3 log-append with a NULL record time, else log-append.
    """
    # case numbers as columns: a CASE chain would re-hash in every condition it tests
    sent = sent.withColumn("_case", hash32(F.col("row_id"), "bad") % cases).withColumn(
        "_tstype", hash32(F.col("row_id"), "tstype") % tstype_cases)
    c = F.col("_case")
    mid, org, lat, path = F.col("messageID"), F.col("originTimestamp"), F.col("stormMilliLatencyMs"), F.col("path")
    f = lambda **kw: to_json_fields(**kw)
    whole = f(messageID=mid, originTimestamp=org, stormMilliLatencyMs=lat, path=path)
    junk = f(messageID=mid, originTimestamp=org, stormMilliLatencyMs=lat,
             path=F.concat(F.slice(path, 1, 1), F.array(F.lit("junk")), F.slice(path, 3, F.size(path))))
    value = (
        F.when(c == 0, F.lit("{bad"))
        .when(c == 1, f(messageID=mid, stormMilliLatencyMs=lat, path=path))
        .when(c == 2, f(messageID=mid, originTimestamp=org, path=path))
        .when(c == 3, f(messageID=mid, originTimestamp=org, stormMilliLatencyMs=lat))
        .when(c == 4, f(messageID=mid, originTimestamp=org, stormMilliLatencyMs=lat,
                        path=F.array().cast("array<string>")))
        .when(c == 5, f(messageID=mid, originTimestamp=org, stormMilliLatencyMs=lat,
                        path=_path_with(path, first=F.lit("A:1:2"))))
        .when(c == 6, f(messageID=mid, originTimestamp=org, stormMilliLatencyMs=lat,
                        path=_path_with(path, last=F.lit("B"))))
        .when(c == 7, f(messageID=mid, originTimestamp=org, stormMilliLatencyMs=lat,
                        path=_path_with(path, first=F.lit("A:x"))))
        .when(c == 8, F.lit(None).cast("string"))
        .when(c == 9, F.lit(""))
        .when(c == 10, junk)
        .when(c == 11, f(messageID=mid, originTimestamp=org, stormMilliLatencyMs=lat, path=F.slice(path, 1, 1)))
        .when(c == 12, F.concat(whole, F.lit(" x")))
        .when(c == 13, F.concat(whole, whole))
        .when(c == 14, F.replace(whole, F.lit('"'), F.lit("'")))
        .when(c == 15, f(messageID=mid, originTimestamp=org, stormMilliLatencyMs=lat,
                         path=F.concat(F.slice(path, 1, 1), F.array(F.lit(None).cast("string")), F.slice(path, 3, F.size(path)))))
        .when(c == 16, F.replace(junk, F.lit('"junk"'), F.lit("5")))
        .otherwise(whole)
    )
    t = F.col("_tstype")
    tstype = F.when(t == 0, F.lit(TS_NONE)).when(t == 1, F.lit(TS_CREATE)).when(
        t == 2, F.lit(None).cast("int")).otherwise(F.lit(TS_LOG_APPEND))
    sent = sent.withColumn("append_ms", F.when(t != 3, F.col("append_ms")))
    return to_outbound(sent, value=value.cast("binary"), timestamp_type=tstype.cast("int"))

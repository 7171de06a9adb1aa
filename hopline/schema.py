"""Row shapes (D1-D8). Times are epoch milliseconds held as bigint."""

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# A Kafka source row (inbound: value is the message UUID; outbound: the payload JSON)
KAFKA_ROW = StructType(
    [
        StructField("key", BinaryType()),
        StructField("value", BinaryType()),
        StructField("topic", StringType()),
        StructField("partition", IntegerType()),
        StructField("offset", LongType()),
        StructField("timestamp", TimestampType()),
        StructField("timestampType", IntegerType()),
    ]
)

# The path message; JSON field order is this declaration order
PATH_MESSAGE = StructType(
    [
        StructField("messageID", StringType()),
        StructField("originTimestamp", LongType()),
        StructField("stormMilliLatencyMs", DoubleType()),
        StructField("path", ArrayType(StringType())),
    ]
)

# internal bookkeeping columns carried by every message row
ROW_ID, EVENT_ID, MSG_TS, STREAM, COPY, LANE = "row_id", "event_id", "msg_ts", "stream", "copy", "lane"
# the slice of the arrival order by which a source was dealt to tasks, where it was (``ranking.dealt_by_slice``); stages hand it on
SLICED = "_slice"
# arrival order at any task: message time, event, stream and copy; the row id makes it total, since offsets
# (the event ids of Kafka rows) repeat between partitions
ARRIVAL_ORDER = [MSG_TS, EVENT_ID, STREAM, COPY, ROW_ID]


def slice_of(df) -> list[str]:
    """The slice column of rows whose source was dealt by slices."""
    return [SLICED] if SLICED in df.columns else []

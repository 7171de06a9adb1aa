"""Windows by time on a stream, closed by a watermark, with late rows kept.

Every micro-batch reduces its rows to partial results of their windows, which merge by an associative aggregate: the state is
one row for each key of an open window, not the window's rows. The watermark is the greatest time seen in earlier batches less
``delay_ms``. A row whose window the watermark had already closed is late: it goes to a side table with a reason, so
each input row is in a result or in that table. Windows that the new watermark closes leave the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.session import cut_lineage
from hopline.streaming.table import CommittedTable

LATE = "behind_watermark"


def close_windows(batch: DataFrame, batch_id: int, state_dir: str, late_dir: str, time_col: str, end_col: str, delay_ms: int,
                  partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The merged partial results of the windows that close with this batch.

    ``batch`` holds each row's time and the end of its window (both ms, the end also a key of the partial results). Commits the state and the late rows.
    """
    spark = batch.sparkSession
    state, marks = CommittedTable(spark, f"{state_dir}/open"), CommittedTable(spark, f"{state_dir}/watermark")
    rows = cut_lineage(batch)
    before = marks.read_before(batch_id)
    past = before.first() if before is not None else None
    closed_to = past["watermark"] if past is not None else None
    is_late = F.lit(False) if closed_to is None else F.coalesce(F.col(end_col) <= closed_to, F.lit(False))
    CommittedTable(spark, late_dir).write(rows.where(is_late).withColumn("reject_reason", F.lit(LATE)), batch_id)
    new = partial(rows.where(~is_late))
    held = state.read_before(batch_id)
    merged = cut_lineage(new if held is None else merge(new.unionByName(held)))
    newest = rows.agg((F.max(time_col) - delay_ms).alias("m")).first()["m"]
    watermark = max((w for w in (newest, closed_to) if w is not None), default=None)
    closes = F.lit(False) if watermark is None else F.coalesce(F.col(end_col) <= watermark, F.lit(False))
    state.write(merged.where(~closes), batch_id)
    marks.write(spark.range(1).select(F.lit(watermark).cast("bigint").alias("watermark")), batch_id)
    for table in (state, marks):
        table.forget_before(batch_id - 1)
    return merged.where(closes)

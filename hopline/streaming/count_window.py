"""Tumbling count windows on a stream (W1, streaming form).

Structured Streaming has event-time windows but no count windows. Each micro-batch is ranked like a batch: the rows left over
from the batch before and the new ones get their arrival rank by ``arrival_rank``, a prefix sum over slices of the order, so
a batch of any size is dealt out over tasks, a hot lane too, and no Python worker holds rows. A lane's running offset turns
the rank into window number and position; full windows leave, and the rest (fewer than N rows a lane) with the offsets is the state.

State is a table of one batch, committed under the query's checkpoint folder. A batch starts from the state of the batch before it,
so a replayed batch gives the same windows and replaces its own state. Batch and stream give the same windows when
micro-batches arrive in arrival order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.operators.lanes import lane_for
from hopline.operators.ranking import arrival_rank
from hopline.operators.windows import lane_hash
from hopline.plans.topology import Component
from hopline.schema import ARRIVAL_ORDER
from hopline.session import cut_lineage
from hopline.streaming.table import CommittedTable


@dataclass(frozen=True)
class CountWindowed:
    """A stream whose micro-batches are to be cut in count windows of ``n``; ``options`` are those of ``arrival_rank``."""

    rows: DataFrame
    comp: Component
    n: int
    grouping: str
    options: dict

    @property
    def isStreaming(self) -> bool:
        return self.rows.isStreaming

    @property
    def writeStream(self):
        return self.rows.writeStream

    def step(self, batch: DataFrame, batch_id: int, state_dir: str) -> DataFrame:
        """The rows of the windows that this batch fills, with ``lane``, ``win`` and ``pos`` (as the batch ``count_window``); commits the state."""
        spark, n = batch.sparkSession, self.n
        rows, ends = CommittedTable(spark, f"{state_dir}/rows"), CommittedTable(spark, f"{state_dir}/ends")
        new = batch.withColumn("lane", lane_for(self.comp, self.grouping)).withColumn("_lh", lane_hash(self.comp))
        held, done = rows.read_before(batch_id), ends.read_before(batch_id)
        every = cut_lineage(new if held is None else new.unionByName(held))
        if done is None:
            done = spark.createDataFrame([], "lane bigint, done bigint")
        ranked = arrival_rank(every, ["lane"], ARRIVAL_ORDER, **self.options).join(
            done.withColumnRenamed("done", "_done"), "lane", "left").withColumn("_done", F.coalesce("_done", F.lit(0).cast("bigint")))
        ranked = cut_lineage(ranked.withColumn("_full", F.expr(f"(group_rows div {n}) * {n}")))
        now_done = ranked.groupBy("lane").agg(F.max(F.col("_done") + F.col("_full")).alias("done"))
        rows.write(ranked.where("rn > _full").select(*every.columns), batch_id)
        ends.write(done.join(now_done, "lane", "left_anti").unionByName(now_done), batch_id)
        for table in (rows, ends):
            table.forget_before(batch_id - 1)  # the state before this batch stays until the next one
        return ranked.where("rn <= _full").select(
            *every.columns, F.expr(f"_done div {n} + (rn - 1) div {n}").alias("win"), (F.col("_done") + F.col("rn")).alias("pos"))


def stream_count_window(df: DataFrame, comp: Component, n: int, grouping: str = "shuffle", **rank_kw) -> CountWindowed:
    """Streaming W1 for ``run_to_table`` and ``run_to_kafka``."""
    return CountWindowed(df, comp, n, grouping, rank_kw)

"""Fan-out (K5-K7): table-valued stages that multiply rows.

Copies share messageID, path and entry time (the message is built once per
input); each copy gets its own key and ``row_id || ':' || copy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.functions.draws import normal_multiplier, unit
from hopline.operators.messages import BOOK_COLS, draw_key, receive, with_created_message
from hopline.plans.topology import Component
from hopline.schema import slice_of


def with_copies(df: DataFrame, count: Column) -> DataFrame:
    """``count`` copies of each row, numbered by ``copy``; 0 explodes an empty array (no row).

    No Filter: the draw would be inlined into its predicate once more.
    """
    df = df.withColumn("_m", count)
    copies = F.when(F.col("_m") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)).otherwise(
        F.array().cast("array<bigint>"))
    return df.withColumn("copy", F.explode(copies)).drop("_m")


def copy_id() -> Column:
    return F.concat(F.col("row_id"), F.lit(":"), F.col("copy").cast("string"))


def _emit_copies(df: DataFrame, comp: Component, count: Column, out_stream: str) -> DataFrame:
    df = with_copies(df, count).withColumn("row_id", copy_id())
    return df.select(
        *BOOK_COLS[:3], F.lit(out_stream).alias("stream"), "copy", "lane",
        F.col("_now").alias("timestamp"),
        draw_key(comp, F.col("row_id")).alias("key"),
        "entryMilliTimestamp", "messageID", "originTimestamp", "stormMilliLatencyMs", "path", *slice_of(df),
    )


def multiplier_draw(comp: Component, vmin: int, vmax: int, mean: float, std: float) -> Column:
    """K3 for each input row of ``comp``."""
    return normal_multiplier(unit(comp.seed, comp.name, "mult", F.col("row_id")), vmin, vmax, mean, std)


def fanout_fixed(spout_rows: DataFrame, comp: Component, n: int, out_stream: str = "pathMessages",
                 grouping: str = "shuffle") -> DataFrame:
    """K6: n copies of each created path message."""
    df = with_created_message(receive(spout_rows, comp, grouping), comp)
    return _emit_copies(df, comp, F.lit(n).cast("bigint"), out_stream)


def fanout_normal(spout_rows: DataFrame, comp: Component, vmin: int = 1, vmax: int = 20, mean: float = 10,
                  std: float = 1.0, out_stream: str = "pathMessages", grouping: str = "shuffle") -> DataFrame:
    """K5: a K3-drawn number of copies; a draw of 0 emits nothing (``sequence(0, -1)`` is guarded)."""
    df = with_created_message(receive(spout_rows, comp, grouping), comp)
    df = df.withColumn("_u", unit(comp.seed, comp.name, "mult", F.col("row_id")))  # hashed once per row
    return _emit_copies(df, comp, normal_multiplier(F.col("_u"), vmin, vmax, mean, std), out_stream).drop("_u")


def split_streams(df: DataFrame, *streams: str) -> DataFrame:
    """K7: the same tuple on each named output stream, from one pass."""
    return df.withColumn("stream", F.explode(F.array(*[F.lit(s) for s in streams])))

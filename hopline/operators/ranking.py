"""Arrival rank within a group that scales past one task per group: a distributed prefix sum over slices of the order.

``row_number() over (partition by lane order by ...)`` puts a whole lane into one task. Here the arrival
order is cut in slices by fixed functions of the order key, so no limits are estimated:

1. rows are counted by group and span of ``width_ms`` of the leading order column. Only the order columns are
   computed for it, and the counts (one row a group and span) are written under the checkpoint folder;
2. spans of more than ``target_rows`` rows are cut further, and only their rows counted again: by the second,
   a crowded second by the millisecond, a crowded millisecond by the second order column, if it is a number (in
   steps that hold ``target_rows`` rows at ``COPIES`` rows for each value). Without such spans these passes do not exist;
3. counts are summed up to offsets; many of them first over days, then inside each day;
4. rows are ranked inside their (group, slice): one exchange of whole rows, one sort, and the offset is added by a join on
   the same keys, which broadcasts the offsets if they are small and else keeps the rows where they are.

An outlying time makes one more small slice, and rows without a time form the first slice. The result is that
of a single ``row_number`` per group, whatever tasks were lost: slices depend on the rows alone.

A source of small rows that stages fan out behind it is better dealt by slices itself (``dealt_by_slice``): the slice rides along,
and as the copies of a slice lie in one task then, step 4 and the counts need no exchange of fanned-out rows at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from hopline.schema import SLICED
from hopline.session import cut_lineage

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
COPIES = 64
FEW_BYTES = 64 << 20  # of counts: so many are summed by one window a group
FIRST = -(1 << 62)  # slice of rows without a value: before all others
SLICE = ["_s0", "_s1", "_s2", "_s3"]
MINUTES = [*SLICE, "_s4"]  # with a level of minutes behind the first


def _levels(df: DataFrame, order_cols: Sequence[str], target_rows: int, width_ms: int, minutes: bool = False) -> list[Column]:
    """The slice numbers of a row from the coarsest on, each non-decreasing along the order where those before it are equal."""
    lead = order_cols[0]
    numbers = [f"`{lead}` div {width_ms}", *[f"`{lead}` div 60000"] * minutes, f"`{lead}` div 1000", f"`{lead}`"]
    numbers += [f"`{c}` div {max(1, target_rows // COPIES)}" for c in order_cols[1:2] if isinstance(df.schema[c].dataType, IntegralType)]
    return [F.coalesce(F.expr(n).cast("bigint"), F.lit(FIRST)) for n in numbers]


def _sliced(df: DataFrame, group_cols: list[str], order_cols: list[str], target_rows: int, width_ms: int,
            minutes: bool = False) -> tuple[DataFrame, DataFrame]:
    """``df`` with the slice columns, and the rows of each (group, slice)."""
    first, *finer = _levels(df, order_cols, target_rows, width_ms, minutes)
    names = MINUTES if minutes else SLICE
    zero = F.lit(0).cast("bigint")
    rows = df.withColumn("_s0", first)
    counts = cut_lineage(rows.groupBy(*group_cols, "_s0").agg(F.count(F.lit(1)).alias("_cnt")))
    found, used = [], 1
    for level in finer:
        crowded = counts.where(F.col("_cnt") > target_rows)
        if crowded.isEmpty():
            break
        keys = [*group_cols, *names[:used]]
        marks = cut_lineage(crowded.select(*keys, F.lit(True).alias("_crowded")))  # its size decides how it is joined
        found.append(counts.where(F.col("_cnt") <= target_rows))
        rows = rows.join(marks, keys, "left").withColumn(
            names[used], F.when(F.col("_crowded"), level).otherwise(zero))
        counts = cut_lineage(rows.where("_crowded").groupBy(*keys, names[used]).agg(F.count(F.lit(1)).alias("_cnt")))
        rows = rows.drop("_crowded")
        used += 1
    found.append(counts)
    whole = [c.select(*group_cols, *[F.col(s) if s in c.columns else zero.alias(s) for s in names], "_cnt") for c in found]
    every = whole[0]
    for c in whole[1:]:
        every = every.unionByName(c)
    return rows.select(*df.columns, *[F.col(s) if s in rows.columns else zero.alias(s) for s in names]), every


def with_slices(df: DataFrame, order_cols: Sequence[str], target_rows: int, width_ms: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """``df`` with the slice columns, non-decreasing along the order inside a group."""
    return _sliced(df, list(group_cols), list(order_cols), target_rows, width_ms)[0]


def dealt_by_slice(df: DataFrame, order_cols: Sequence[str], tasks: int, target_rows: int, width_ms: int = HOUR_MS) -> DataFrame:
    """``df`` with its slice as ``SLICED`` (a struct, ordered as the rows are), dealt by it to ``tasks`` or more: a slice is in one task, and has
    about ``target_rows`` rows at most, however times lie; tasks have as many on average.
    The arrival order of whatever is made of the rows has to begin with ``order_cols``."""
    rows, counts = _sliced(df, [], list(order_cols), target_rows, width_ms, minutes=True)
    total = counts.agg(F.sum("_cnt")).first()[0] or 0
    return rows.withColumn(SLICED, F.struct(*MINUTES)).drop(*MINUTES).repartition(max(tasks, -(-total // target_rows)), SLICED)


def _offsets(counts: DataFrame, group_cols: list[str], spans_a_day: int, names: Sequence[str] = SLICE) -> DataFrame:
    """(group, slice, ``_off``, ``group_rows``): the rows of a group before the slice, and all of them."""
    whole, upto = Window.partitionBy(*group_cols), (Window.unboundedPreceding, -1)
    size = int(str(counts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= FEW_BYTES:
        before = F.sum("_cnt").over(whole.orderBy(*names).rowsBetween(*upto))
        return counts.select(*group_cols, *names, F.coalesce(before, F.lit(0)).cast("bigint").alias("_off"),
                             F.sum("_cnt").over(whole).cast("bigint").alias("group_rows"))
    counts = counts.withColumn("_day", F.expr(f"{'_s0' if '_s0' in names else f'{names[0]}._s0'} div {spans_a_day}"))
    days = counts.groupBy(*group_cols, "_day").agg(F.sum("_cnt").alias("_cnt")).select(
        *group_cols, "_day",
        F.coalesce(F.sum("_cnt").over(whole.orderBy("_day").rowsBetween(*upto)), F.lit(0)).alias("_before"),
        F.sum("_cnt").over(whole).cast("bigint").alias("group_rows"),
    )
    in_day = Window.partitionBy(*group_cols, "_day").orderBy(*names).rowsBetween(*upto)
    return cut_lineage(counts.withColumn("_sofar", F.coalesce(F.sum("_cnt").over(in_day), F.lit(0))).join(
        days, [*group_cols, "_day"]).select(
        *group_cols, *names, (F.col("_before") + F.col("_sofar")).cast("bigint").alias("_off"), "group_rows"))


def _ranked_where_dealt(df: DataFrame, group_cols: list[str], order_cols: list[str]) -> DataFrame:
    """``arrival_rank`` of rows whose source was dealt by slices. The groups of a slice are one row of offsets, joined by the slice alone,
    which is how the rows lie already."""
    counts = cut_lineage(df.groupBy(*group_cols, SLICED).agg(F.count(F.lit(1)).alias("_cnt")))
    group = F.struct(*group_cols)
    # written fields may be null by type, which would make the join cast the rows' slices, and so deal the rows anew
    same = F.struct(*[F.coalesce(F.col(f"{SLICED}.{s}"), F.lit(FIRST)).alias(s) for s in MINUTES])
    offsets = _offsets(counts, group_cols, DAY_MS // HOUR_MS, [SLICED]).withColumn(SLICED, same).groupBy(SLICED).agg(
        F.map_from_entries(F.collect_list(F.struct(group.alias("g"), F.struct("_off", "group_rows").alias("o")))).alias("_offsets"))
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(SLICED, *group_cols).orderBy(*order_cols)))
    own = ranked.join(offsets, SLICED).withColumn("_o", F.element_at("_offsets", group))
    return own.select(*df.columns, (F.col("_o._off") + F.col("_rn")).alias("rn"), F.col("_o.group_rows").alias("group_rows"))


def arrival_rank(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    target_rows: int = 1 << 20,
    width_ms: int = HOUR_MS,
    keep_slices: bool = False,
) -> DataFrame:
    """Add ``rn`` (1-based rank in group by ``order_cols``) and ``group_rows``; with ``keep_slices`` the ``SLICE`` columns
    too, by which (and the group) the rows are dealt to tasks, so that later steps can start inside a slice without an exchange.

    ``order_cols`` must be a total order within a group, led by a time in ms (bigint); group columns hold no nulls.
    ``df`` is computed twice: its group and order columns for the counts, and whole. Cut its lineage first if that is dear.
    Rows whose source was dealt by slices keep those, whatever the sizes given here, and stay in their tasks.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    if SLICED in df.columns:
        return _ranked_where_dealt(df, group_cols, order_cols)
    sliced, counted = _sliced(df, group_cols, order_cols, target_rows, width_ms)
    offsets = _offsets(counted, group_cols, max(1, DAY_MS // width_ms))
    ranked = sliced.withColumn("_rn", F.row_number().over(Window.partitionBy(*group_cols, *SLICE).orderBy(*order_cols)))
    return ranked.join(offsets, [*group_cols, *SLICE]).select(
        *df.columns, (F.col("_off") + F.col("_rn")).alias("rn"), "group_rows", *(SLICE if keep_slices else ()))

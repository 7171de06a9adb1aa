"""Tumbling count windows and the windowed stages (W1-W6), batch form.

A count window of N per lane is the run of N consecutive arrivals at one task.
Arrival order is (message time, event id, stream, copy). A trailing partial
window never fires and its rows are dropped. The stateful streaming form is in
``hopline.streaming.count_window``; both give the same windows when input
arrives in order.

Picks ("one random tuple", "a random path") take the least salted hash (the
window component's lane hash for rows, a path hash for paths), so each is
uniform and reproducible.

Picks, sums and maxima merge, so they are made in two steps: first inside each slice of the
ranking, where a window's rows already lie together in one task, then over the (at most few)
rows that a slice left of each window. Only these go through the exchange on (lane, win): of
a window of N tuples about one or two rows, not N. Both steps are window functions and a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.functions.draws import hash32
from hopline.functions.paths import append_element, path_string, spout_task
from hopline.operators.fanout import split_streams
from hopline.operators.lanes import lane_for
from hopline.operators.messages import draw_key, transfer_row, with_created_message
from hopline.operators.ranking import SLICE, arrival_rank
from hopline.plans.topology import Component
from hopline.schema import ARRIVAL_ORDER, SLICED, slice_of

CARRIED = [
    "row_id", "event_id", "msg_ts", "stream", "copy", "timestamp", "entryMilliTimestamp",
    "messageID", "originTimestamp", "stormMilliLatencyMs", "path",
]


def lane_hash(comp: Component) -> Column:
    """The shuffle-grouping hash at ``comp``: lane = value % lanes; the full value also
    orders the random pick inside a window (uniform: within a lane only the quotient varies)."""
    return hash32(comp.seed, comp.name, "lane", F.col("row_id"))


def count_window(df: DataFrame, comp: Component, n: int, grouping: str = "shuffle", **rank_kw) -> DataFrame:
    """Assign each row of a full window its ``lane``, ``win`` and arrival position ``pos`` (and the slice that ranked it)."""
    if grouping == "shuffle":
        d = df.withColumn("_lh", lane_hash(comp)).withColumn("lane", F.col("_lh") % comp.lanes)
    else:
        d = df.withColumn("lane", lane_for(comp, grouping)).withColumn("_lh", lane_hash(comp))
    d = arrival_rank(d, ["lane"], ARRIVAL_ORDER, keep_slices=True, **rank_kw)
    d = d.where(F.col("rn") <= F.expr(f"(group_rows div {n}) * {n}"))
    return d.withColumn("win", F.expr(f"(rn - 1) div {n}")).withColumnRenamed("rn", "pos").drop("group_rows")


def _pick_key(comp: Component, df: DataFrame | None = None) -> Column:
    h = F.col("_lh") if df is not None and "_lh" in df.columns else lane_hash(comp)
    return F.struct(h.alias("h"), F.col("row_id").alias("r"))


def _one_row(comp: Component, w: DataFrame) -> Column:
    """The pick key, total also where a row comes twice: its position decides."""
    return F.struct(_pick_key(comp, w).alias("k"), F.col("pos").alias("at")) if "pos" in w.columns else _pick_key(comp, w)


def _picked(w: DataFrame, pick: Column, group: tuple = (), sum_of: str | None = None, choice: Column | None = None,
            among: tuple = ()) -> DataFrame:
    """The row of the least ``pick`` of each (window, ``group``), with the group's ``_sum`` and ``_cnt`` and the window's ``_mx``.

    With ``choice`` (equal in a group) only the group of the least one of each (window, ``among``) stays. Sums, counts and least
    values of parts merge to those of the whole, and a group or row that is not the least of its part is not the least
    of all, so the same step runs inside each slice of the ranking first, if ``w`` has slices.
    """
    inside = [s for s in (*SLICE, SLICED) if s in w.columns]
    d = w.withColumns({"_pick": pick, "_mx": F.col("timestamp")})
    if sum_of:
        d = d.withColumns({"_cnt": F.lit(1).cast("bigint"), "_sum": F.col(sum_of)})
    kept = group if choice is None else among  # one row of each stays, so a slice's ``_mx`` may be theirs
    for keys, mx_of in ([(["lane", *inside, "win"], kept)] if inside else []) + [(["lane", "win"], ())]:
        by_group = Window.partitionBy(*keys, *group)
        d = d.withColumns({"_first": F.min("_pick").over(by_group),
                           **{c: F.sum(c).over(by_group) for c in ("_cnt", "_sum") if sum_of}})
        least = F.col("_pick") == F.col("_first")
        if choice is not None:
            d = d.withColumn("_chosen", F.min(choice).over(Window.partitionBy(*keys, *among)))
            least = least & (choice == F.col("_chosen"))
        d = d.withColumn("_mx", F.max("_mx").over(Window.partitionBy(*keys, *mx_of))).where(least)
    return d


def _carried(cols=CARRIED) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def _emit(p: str, comp: Component, now: Column, out_stream: str, *, entry: Column, origin: Column) -> list[Column]:
    """Output tuple of a window from carried struct ``p``: new element, key, clock and entry time."""
    pc = lambda c: F.col(f"{p}.{c}")
    return [
        pc("row_id").alias("row_id"), pc("event_id").alias("event_id"), pc("msg_ts").alias("msg_ts"),
        F.lit(out_stream).alias("stream"), pc("copy").alias("copy"), F.col("lane"),
        now.alias("timestamp"),
        draw_key(comp, pc("row_id")).alias("key"),
        entry.cast("bigint").alias("entryMilliTimestamp"),
        pc("messageID").alias("messageID"),
        origin.cast("bigint").alias("originTimestamp"),
        pc("stormMilliLatencyMs").alias("stormMilliLatencyMs"),
        append_element(pc("path"), comp.element(F.col("lane"))).alias("path"),
        F.col("win"),
    ]


def _windowed(df: DataFrame, comp: Component, n: int, create_path_msg: bool, windowed: bool = False,
              **rank_kw) -> DataFrame:
    """Rows of full windows; ``windowed=True`` means ``df`` already carries lane, win and pos
    (e.g. from the stateful streaming count window)."""
    w = df if windowed else count_window(df, comp, n, **rank_kw)
    return with_created_message(w, comp) if create_path_msg else w


def window_transfers(w: DataFrame, comp: Component) -> DataFrame:
    """M6 rows of a windowed stage: every tuple of a full window is received when the window fires."""
    mx = F.max("timestamp").over(Window.partitionBy("lane", "win"))
    now = comp.clock.window(F.col("_mx"), F.col("lane"), F.col("win"), comp.name)
    return w.withColumn("_mx", mx).withColumn("_now", now).select(
        *transfer_row(comp, F.col("lane"), F.col("_now"), F.col("timestamp")))


def emit_all(df: DataFrame, comp: Component, n: int, out_stream: str = "pathMessages", **rank_kw) -> DataFrame:
    """Re-emit every message of a full window; emitted entry time = message origin time."""
    w = _windowed(df, comp, n, False, **rank_kw)
    w = w.withColumn("_mx", F.max("timestamp").over(Window.partitionBy("lane", "win")))
    now = comp.clock.window(F.col("_mx"), F.col("lane"), F.col("win"), comp.name)
    w = w.withColumn("_now", now).withColumn("p", _carried())
    return w.select(*_emit("p", comp, F.col("_now"), out_stream,
                           entry=F.col("p.originTimestamp"), origin=F.col("p.originTimestamp")))


def emit_by_spout(df: DataFrame, comp: Component, n: int, out_stream: str = "pathMessages", **rank_kw) -> DataFrame:
    """Per spout task in a window, average entry time (integer division) and one random message."""
    w = _windowed(df, comp, n, False, **rank_kw).withColumn("spout_task", spout_task(F.col("path")))
    d = _picked(w, _one_row(comp, w), group=("spout_task",), sum_of="entryMilliTimestamp")
    now = comp.clock.window(F.col("_mx"), F.col("lane"), F.col("win"), comp.name)
    avg = F.expr("_sum div _cnt")
    return d.withColumn("_now", now).withColumn("p", _carried()).select(
        *_emit("p", comp, F.col("_now"), out_stream, entry=avg, origin=avg), "spout_task"
    )


def emit_one(df: DataFrame, comp: Component, n: int, create_path_msg: bool = False, group_by: str = "tuple",
             out_stream: str = "pathMessages", **rank_kw) -> DataFrame:
    """One output per window.

    ``group_by='tuple'`` (W4a, what the modelled bolt does: its path map is keyed by
    array identity, so every tuple is its own group): a uniformly random tuple, whose
    own entry time becomes the average. ``group_by='path'`` (W4b): a uniformly random
    distinct path, entry times averaged over it, its first arrival emitted.
    With ``create_path_msg`` the window builds the message itself, so its own element
    appears twice in the path.
    """
    w = _windowed(df, comp, n, create_path_msg, **rank_kw)
    if group_by == "tuple":
        d = _picked(w, _one_row(comp, w))
        now = comp.clock.window(F.col("_mx"), F.col("lane"), F.col("win"), comp.name)
        entry = F.col("p.entryMilliTimestamp")
        return d.withColumn("_now", now).withColumn("p", _carried()).select(
            *_emit("p", comp, F.col("_now"), out_stream, entry=entry, origin=entry))
    if group_by != "path":
        raise ValueError(f"unknown group_by {group_by!r}")
    w = w.withColumn("_ps", path_string(F.col("path"), " ")).withColumn(
        "_hp", hash32(comp.seed, comp.name, "path", F.col("lane"), F.col("win"), F.col("_ps")))
    choice = F.struct(F.col("_hp").alias("h"), F.col("_ps").alias("s"))
    d = _picked(w, F.col("pos"), group=("_ps",), sum_of="entryMilliTimestamp", choice=choice)
    now = comp.clock.window(F.col("_mx"), F.col("lane"), F.col("win"), comp.name)
    avg = F.expr("_sum div _cnt")
    return d.withColumn("_now", now).withColumn("p", _carried()).select(
        *_emit("p", comp, F.col("_now"), out_stream, entry=avg, origin=avg)
    )


def join_split(df: DataFrame, comp: Component, n: int, out1: str = "Stream3", out2: str = "Stream4",
               windowed: bool = False, **rank_kw) -> DataFrame:
    """One count window over the union of input streams; per source stream a
    uniformly random distinct path, its origin times averaged, a random message of
    it emitted with origin and entry := average, then the same tuple on two streams.
    No key is compared: it is a windowed union, not a relational join.
    """
    w = df if windowed else count_window(df, comp, n, **rank_kw)
    w = w.withColumn("_ps", path_string(F.col("path"), " ")).withColumn(
        "_hp", hash32(comp.seed, comp.name, "path", F.col("lane"), F.col("win"), F.col("stream"), F.col("_ps")))
    choice = F.struct(F.col("_hp").alias("h"), F.col("_ps").alias("s"))
    d = _picked(w, _one_row(comp, w), group=("stream", "_ps"), sum_of="originTimestamp", choice=choice, among=("stream",))
    avg = F.expr("_sum div _cnt")
    now = comp.clock.window(F.col("_mx"), F.col("lane"), F.col("win"), comp.name)
    out = d.withColumn("_now", now).withColumn("p", _carried()).select(
        *_emit("p", comp, F.col("_now"), out1, entry=avg, origin=avg), F.col("stream").alias("source_stream")
    )
    return split_streams(out, out1, out2)


def by_arrival_time(df: DataFrame, comp: Component, window_ms: int) -> DataFrame:
    """Rows with their task ``lane``, arrival time ``_arr`` and tumbling window ``win`` at ``comp``."""
    arrival = comp.clock.hop(F.col("timestamp"), F.col("row_id"), comp.name)
    return df.withColumn("_lh", lane_hash(comp)).withColumn("lane", F.col("_lh") % comp.lanes).withColumn(
        "_arr", arrival).withColumn("win", F.expr(f"_arr div {window_ms}"))


def join_split_time(df: DataFrame, comp: Component, window_ms: int = 2000, out1: str = "Stream3",
                    out2: str = "Stream4") -> DataFrame:
    """W5 over tumbling processing-time windows of ``window_ms`` at each task.

    A row arrives at ``clock.hop(timestamp)``; its window is ``arrival div window_ms``;
    the window fires at its end, ``(win + 1) * window_ms``. No ranking is needed. Rows merge to one partial result a window,
    stream and path before they are exchanged, so a window may hold any number of rows; a row that comes twice gives one pick.
    Where the source was dealt by slices, each slice leaves one partial result of a window and stream, and these are exchanged once.
    A batch has one wall clock time for all of its rows, so it needs a clock that gives each row its own; the stream form takes any.
    """
    if not comp.clock.knows_append_time:
        raise ValueError("time windows over a batch need a clock that gives each row its own time, e.g. SyntheticClock()")
    partials = split_partials(by_arrival_time(df, comp, window_ms), comp, EMITTED)
    if slice_of(partials):
        partials = partials_of_slices(partials, comp)
    return split_of_partials(partials, comp, window_ms, out1, out2)


PARTIAL_KEYS = ["lane", "win", "stream", "_ps"]
EMITTED = ["row_id", "event_id", "msg_ts", "copy", "messageID", "stormMilliLatencyMs", "path"]  # of a pick, what W6 emits


def split_partials(w: DataFrame, comp: Component, cols: list[str] = CARRIED) -> DataFrame:
    """W5/W6 as a mergeable state: per window, source stream and path (and slice) the origin sum, the row count and the least pick with its row."""
    ps = w.withColumn("_ps", path_string(F.col("path"), " "))
    # a pick is ordered by hash and row id, and the row's columns begin with its id
    pick = _pick_key(comp, w) if cols is CARRIED else _pick_key(comp, w).getField("h")
    row = F.struct(pick.alias("pick"), _carried(cols).alias("p"))
    return merged_partials(ps.select(
        *slice_of(w), *PARTIAL_KEYS, F.lit(1).cast("bigint").alias("_cnt"), F.col("originTimestamp").alias("_sum"), row.alias("_best")))


def merged_partials(partials: DataFrame) -> DataFrame:
    """Partial results of the same window, stream and path (and slice) as one; any grouping of them gives the same."""
    return partials.groupBy(*slice_of(partials), *PARTIAL_KEYS).agg(
        F.sum("_cnt").alias("_cnt"), F.sum("_sum").alias("_sum"), F.min("_best").alias("_best"))


def _chosen(partials: DataFrame, comp: Component) -> DataFrame:
    """Per window and source stream (and slice) ``c``: the partial result of the path of the least hash."""
    h = hash32(comp.seed, comp.name, "path", F.col("lane"), F.col("win"), F.col("stream"), F.col("_ps"))
    return partials.groupBy(*slice_of(partials), "lane", "win", "stream").agg(F.min(F.struct(
        h.alias("h"), F.col("_ps").alias("s"), "_cnt", "_sum", "_best")).alias("c"))


def partials_of_slices(partials: DataFrame, comp: Component) -> DataFrame:
    """Partial results by slice as those of the whole. A path that is not the least of its slice is not the least of the window, so each slice
    hands on one of a window and stream, and its path comes with its row; one exchange by window and stream serves here and for the choice."""
    few = _chosen(partials, comp).select("lane", "win", "stream", "c._cnt", "c._sum", "c._best")
    together = few.repartition("lane", "win", "stream")
    return merged_partials(together.withColumn("_ps", path_string(F.col("_best.p.path"), " ")))


def split_of_partials(partials: DataFrame, comp: Component, window_ms: int, out1: str = "Stream3", out2: str = "Stream4") -> DataFrame:
    """W6 output of closed windows: per source stream the path of the least hash, its average origin and its least pick, on two streams."""
    chosen = _chosen(partials, comp).select(
        "lane", "win", F.col("stream").alias("source_stream"), F.col("c._best.p").alias("p"), F.expr("c._sum div c._cnt").alias("_avg"))
    now = (F.col("win") + 1) * F.lit(window_ms)
    out = chosen.select(*_emit("p", comp, now, out1, entry=F.col("_avg"), origin=F.col("_avg")), "source_stream")
    return split_streams(out, out1, out2)

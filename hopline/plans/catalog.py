"""The registered queries: one per operator / pipeline, each with its DuckDB oracle.

Every query reads the provided tables (``events``) and runs over all of it.
Array columns are reported as ``>``-joined strings so both engines compare
them as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline.functions.clock import SyntheticClock
from hopline.functions.draws import normal_multiplier, unit, weighted_key
from hopline.functions.paths import parse_payload, path_string, spout_task, to_payload
from hopline.operators import fanout, lanes, messages, metrics, validate, windows
from hopline.plans import oracle as O
from hopline.plans import pipelines as P
from hopline.plans.topology import Routed, Topology
from hopline.sources.fixtures import corrupt_payload, inbound_from, read_table
from hopline.sources.kafka import mint_message_id, results_rows, spout

MSG_OUT = [
    "row_id", "stream", "lane", "timestamp", "key", "entryMilliTimestamp",
    "messageID", "originTimestamp", "stormMilliLatencyMs",
]
WINDOWED = ("window", "fish", "all")  # pipelines whose source is dealt by slices of the arrival order
SENT_OUT = MSG_OUT + ["sink", "append_ms"]
MSG_SQL = ", ".join(MSG_OUT) + ", array_to_string(path, '>') AS path_str"
SENT_SQL = ", ".join(SENT_OUT) + ", array_to_string(path, '>') AS path_str"


def msg_out(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*MSG_OUT, path_string(F.col("path")).alias("path_str"), *extra)


def sent_out(df: DataFrame, *extra) -> DataFrame:
    return df.select(*SENT_OUT, path_string(F.col("path")).alias("path_str"), *extra)


def _value() -> F.Column:
    return to_payload(F.col("messageID"), F.col("originTimestamp"), F.col("stormMilliLatencyMs"), F.col("path"))


def synthetic() -> Topology:
    """A topology on the deterministic clock, so that SQL can compute the same times."""
    return Topology(clock=SyntheticClock())


def _topo_of(*names: str):
    t = synthetic()
    return t, [t.component(n) for n in names]


def _sql(build: Callable[[O.Sql], str]) -> str:
    s = O.Sql()
    return s.final(build(s))


# ---------------------------------------------------------------- sources


def q_spout_ingest(spark, sf):
    _, (sp,) = _topo_of("TimerSpout")
    return spout(inbound_from(spark, sf), sp).select(
        "row_id", "event_id", "stream", "lane", "timestamp", "uuid", "entryMilliTimestamp", "messageTimestamp", "path"
    )


def s_spout_ingest(s):
    sp = O.spout(s, O.Comp("TimerSpout", 0))
    return f"SELECT row_id, event_id, stream, lane, timestamp, uuid, entryMilliTimestamp, messageTimestamp, path FROM {sp}"


def q_spout_multi_stream(spark, sf):
    _, (sp,) = _topo_of("TimerSpout")
    return spout(inbound_from(spark, sf), sp, num_streams=2).select("row_id", "stream", "lane", "path", "entryMilliTimestamp")


def s_spout_multi_stream(s):
    sp = O.spout(s, O.Comp("TimerSpout", 0), num_streams=2)
    return f"SELECT row_id, stream, lane, path, entryMilliTimestamp FROM {sp}"


def q_mint_message_id(spark, sf):
    return read_table(spark, sf, "events").select("event_id", mint_message_id(F.col("event_id")).alias("message_id"))


def s_mint_message_id(s):
    m = "md5(CAST(event_id AS VARCHAR))"
    return (
        f"SELECT event_id, concat_ws('-', substr({m}, 1, 8), substr({m}, 9, 4), substr({m}, 13, 4), "
        f"substr({m}, 17, 4), substr({m}, 21, 12)) AS message_id FROM events"
    )


# ---------------------------------------------------------------- projections


def q_path_create(spark, sf):
    _, (sp, pb) = _topo_of("TimerSpout", "PathBolt")
    d = messages.with_created_message(messages.receive(spout(inbound_from(spark, sf), sp), pb), pb)
    return d.select("row_id", "messageID", "originTimestamp", "stormMilliLatencyMs",
                    path_string(F.col("path")).alias("path_str"), _value().alias("value"))


def s_path_create(s):
    sp = O.spout(s, O.Comp("TimerSpout", 0))
    pb = O.Comp("PathBolt", 1)
    c = O.created(s, O.receive(s, sp, pb), pb)
    return (f"SELECT row_id, messageID, originTimestamp, stormMilliLatencyMs, array_to_string(path, '>') AS path_str, "
            f"{O.payload_json()} AS value FROM {c}")


def q_path_append(spark, sf):
    return P.f2f(inbound_from(spark, sf), synthetic()).select(
        "row_id", path_string(F.col("path")).alias("path_str"), F.size("path").cast("bigint").alias("path_len")
    )


def s_path_append(s):
    x = O.p_f2f(s)
    return f"SELECT row_id, array_to_string(path, '>') AS path_str, CAST(len(path) AS BIGINT) AS path_len FROM {x}"


def _clean_receiver(spark, sf, pipeline=P.basic):
    inbound = inbound_from(spark, sf, by_time=pipeline is P.fish)
    return P.receiver(messages.to_outbound(pipeline(inbound, synthetic())))


def _clean_receiver_sql(s, pipeline=O.p_basic):
    return O.validated(s, O.outbound(s, pipeline(s)))


def q_parse_payload(spark, sf):
    rows = results_rows(messages.to_outbound(P.basic(inbound_from(spark, sf), synthetic())))
    p = rows.select("row_id", parse_payload(F.col("value")).alias("p"))
    return p.select("row_id", "p.messageID", "p.originTimestamp", "p.stormMilliLatencyMs",
                    path_string(F.col("p.path")).alias("path_str"), F.size("p.path").cast("bigint").alias("path_len"))


def s_parse_payload(s):
    v = _clean_receiver_sql(s)
    return (f"SELECT row_id, messageID, originTimestamp, stormMilliLatencyMs, array_to_string(path, '>') AS path_str, "
            f"CAST(len(path) AS BIGINT) AS path_len FROM {v}")


def q_serialise_payload(spark, sf):
    return P.basic(inbound_from(spark, sf), synthetic()).select("row_id", _value().alias("value"))


def s_serialise_payload(s):
    return f"SELECT row_id, {O.payload_json()} AS value FROM {O.p_basic(s)}"


def q_path_endpoints(spark, sf):
    return _clean_receiver(spark, sf).select("row_id", "spout_component", "spout_task", "sink_component", "sink_task")


def s_path_endpoints(s):
    return f"SELECT row_id, spout_component, spout_task, sink_component, sink_task FROM {_clean_receiver_sql(s)}"


def q_path_string(spark, sf):
    return P.basic(inbound_from(spark, sf), synthetic()).select(
        "row_id", path_string(F.col("path"), ">").alias("path_gt"), path_string(F.col("path"), " ").alias("path_space")
    )


def s_path_string(s):
    return (f"SELECT row_id, array_to_string(path, '>') AS path_gt, array_to_string(path, ' ') AS path_space "
            f"FROM {O.p_basic(s)}")


def q_spout_task(spark, sf):
    return P.basic(inbound_from(spark, sf), synthetic()).select("row_id", spout_task(F.col("path")).alias("spout_task"))


def s_spout_task(s):
    return f"SELECT row_id, {O.spout_task_sql()} AS spout_task FROM {O.p_basic(s)}"


def q_path_bolt(spark, sf):
    _, (sp, pb) = _topo_of("TimerSpout", "PathBolt")
    return msg_out(messages.path_bolt(spout(inbound_from(spark, sf), sp), pb))


def s_path_bolt(s):
    sp = O.spout(s, O.Comp("TimerSpout", 0))
    return f"SELECT {MSG_SQL} FROM {O.path_bolt(s, sp, O.Comp('PathBolt', 1))}"


def q_path_adder(spark, sf):
    _, (sp, pb, pa) = _topo_of("TimerSpout", "PathBolt", "PathAdderBolt")
    p = messages.path_bolt(spout(inbound_from(spark, sf), sp), pb)
    return msg_out(messages.path_adder(p, pa, grouping="fields"))


def s_path_adder(s):
    return f"SELECT {MSG_SQL} FROM {O.p_f2f(s, upto='adder')}"


def q_send_stage(spark, sf):
    return sent_out(P.basic(inbound_from(spark, sf), synthetic()))


def s_send_stage(s):
    return f"SELECT {SENT_SQL} FROM {O.p_basic(s)}"


# ---------------------------------------------------------------- filters


def _corrupt_rows(spark, sf):
    return results_rows(corrupt_payload(P.basic(inbound_from(spark, sf), synthetic())))


def _corrupt_rows_sql(s):
    return O.outbound(s, O.p_basic(s), corrupt=True)


def q_filter_timestamp_type(spark, sf):
    return validate.timestamp_type_reason(_corrupt_rows(spark, sf)).select("row_id", "sink", "timestampType", "reject_reason")


def s_filter_timestamp_type(s):
    r = _corrupt_rows_sql(s)
    return (f"SELECT row_id, sink, timestampType, CASE WHEN timestampType IS NULL OR timestampType = -1 OR kafka_ts IS NULL "
            f"THEN 'no_timestamp' "
            f"WHEN timestampType <> 1 THEN 'not_log_append' END AS reject_reason FROM {r}")


ACCEPTED_ONLY = ["spout_component", "spout_task", "sink_component", "sink_task"]


def q_validate_payload(spark, sf):
    v = validate.validate_payload(_corrupt_rows(spark, sf))
    ok = F.col("reject_reason").isNull()
    return v.select("row_id", "sink", "reject_reason", *[F.when(ok, F.col(c)).alias(c) for c in ACCEPTED_ONLY])


def s_validate_payload(s):
    v = O.validated(s, _corrupt_rows_sql(s))
    cols = ", ".join(f"CASE WHEN reject_reason IS NULL THEN {c} END AS {c}" for c in ACCEPTED_ONLY)
    return f"SELECT row_id, sink, reject_reason, {cols} FROM {v}"


def q_reject_counts(spark, sf):
    return validate.reject_counts(validate.validate_payload(_corrupt_rows(spark, sf)))


def s_reject_counts(s):
    v = O.validated(s, _corrupt_rows_sql(s))
    return f"SELECT COALESCE(reject_reason, 'accepted') AS outcome, count(*) AS rows FROM {v} GROUP BY 1"


# ---------------------------------------------------------------- keyed draws


def q_weighted_key(spark, sf):
    u = unit(42, "PathBolt", "key", F.col("row_id"))
    ev = read_table(spark, sf, "events").select(F.col("event_id").cast("string").alias("row_id"))
    return ev.select("row_id", u.alias("u"), weighted_key(u).alias("key"))


def s_weighted_key(s):
    u = O.U("42", "'PathBolt'", "'key'", "row_id")
    return f"SELECT row_id, {u} AS u, {O.key_of(u)} AS key FROM (SELECT CAST(event_id AS VARCHAR) AS row_id FROM events)"


def _multi_fanout(spark, sf):
    _, (sp, mp) = _topo_of("TimerSpout", "MultiPathBolt")
    return fanout.fanout_fixed(spout(inbound_from(spark, sf), sp), mp, 10)


def q_key_distribution(spark, sf):
    return metrics.key_distribution(_multi_fanout(spark, sf))


def s_key_distribution(s):
    x = O.p_multi(s, upto="fanout")
    weights = ", ".join(f"({O.q(k)}, {O.dbl(w)})" for k, w in zip(O.KEYS, metrics.KEY_WEIGHTS))
    return (
        f"SELECT w.key, w.weight, CAST(COALESCE(c.observed, 0) AS BIGINT) AS observed, "
        f"CAST(COALESCE(c.observed, 0) AS DOUBLE) / CAST(sum(COALESCE(c.observed, 0)) OVER () AS DOUBLE) AS share "
        f"FROM (VALUES {weights}) w(key, weight) LEFT JOIN "
        f"(SELECT key, count(*) AS observed FROM {x} GROUP BY key) c ON w.key = c.key"
    )


def _mult_draws(spark, sf):
    u = unit(42, "PathMultiplier", "mult", F.col("row_id"))
    ev = read_table(spark, sf, "events").select(F.col("event_id").cast("string").alias("row_id"))
    return ev.select("row_id", u.alias("u"), normal_multiplier(u, 1, 20, 10, 1.0).alias("multiplier"))


def _mult_draws_sql():
    u = O.U("42", "'PathMultiplier'", "'mult'", "row_id")
    return f"SELECT row_id, {u} AS u, {O.multiplier_of(u)} AS multiplier FROM (SELECT CAST(event_id AS VARCHAR) AS row_id FROM events)"


def q_normal_multiplier(spark, sf):
    return _mult_draws(spark, sf)


def s_normal_multiplier(s):
    return _mult_draws_sql()


def q_multiplier_distribution(spark, sf):
    return metrics.multiplier_distribution(_mult_draws(spark, sf))


def s_multiplier_distribution(s):
    m = s.add(_mult_draws_sql(), "md")
    return (f"SELECT multiplier, count(*) AS rows, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share "
            f"FROM {m} GROUP BY multiplier")


# ---------------------------------------------------------------- fan-out


def q_fanout_normal(spark, sf):
    _, (sp, pm) = _topo_of("TimerSpout", "PathMultiplier")
    return msg_out(fanout.fanout_normal(spout(inbound_from(spark, sf), sp), pm, 1, 20, 10, 1.0), "copy")


def s_fanout_normal(s):
    sp = O.spout(s, O.Comp("TimerSpout", 0))
    pm = O.Comp("PathMultiplier", 1)
    return f"SELECT {MSG_SQL}, copy FROM {O.fanout(s, sp, pm, O.mult_draw(pm), 'pathMessages')}"


def q_fanout_fixed(spark, sf):
    return msg_out(_multi_fanout(spark, sf), "copy")


def s_fanout_fixed(s):
    return f"SELECT {MSG_SQL}, copy FROM {O.p_multi(s, upto='fanout')}"


def q_split_streams(spark, sf):
    return fanout.split_streams(q_path_bolt_frame(spark, sf), "Stream3", "Stream4").select("row_id", "stream", "key")


def q_path_bolt_frame(spark, sf):
    _, (sp, pb) = _topo_of("TimerSpout", "PathBolt")
    return messages.path_bolt(spout(inbound_from(spark, sf), sp), pb)


def s_split_streams(s):
    sp = O.spout(s, O.Comp("TimerSpout", 0))
    pb = O.path_bolt(s, sp, O.Comp("PathBolt", 1))
    return f"SELECT row_id, unnest(['Stream3', 'Stream4']) AS stream, key FROM {pb}"


# ---------------------------------------------------------------- lanes


def q_lane_shuffle(spark, sf):
    _, (sp, pb) = _topo_of("TimerSpout", "PathBolt")
    d = spout(inbound_from(spark, sf), sp).withColumn("lane", lanes.shuffle_lane(pb))
    return d.select("row_id", "lane", pb.task(F.col("lane")).alias("task"))


def s_lane_shuffle(s):
    sp = O.spout(s, O.Comp("TimerSpout", 0))
    pb = O.Comp("PathBolt", 1)
    return f"SELECT row_id, lane, CAST({pb.task()} AS BIGINT) AS task FROM (SELECT row_id, {O.lane_expr(pb)} AS lane FROM {sp})"


def _fields_lanes(spark, sf):
    t, (sp, pb, pa) = _topo_of("TimerSpout", "PathBolt", "PathAdderBolt")
    d = messages.path_bolt(spout(inbound_from(spark, sf), sp), pb).withColumn("lane", lanes.fields_lane(pa, "key"))
    return d.select("row_id", "key", "lane", pa.task(F.col("lane")).alias("task")), pa


def _fields_lanes_sql(s):
    sp = O.spout(s, O.Comp("TimerSpout", 0))
    pb = O.path_bolt(s, sp, O.Comp("PathBolt", 1))
    pa = O.Comp("PathAdderBolt", 2)
    return s.add(
        f"SELECT row_id, key, lane, CAST({pa.task()} AS BIGINT) AS task FROM "
        f"(SELECT row_id, key, {O.lane_expr(pa, 'fields')} AS lane FROM {pb})",
        "lf",
    )


def q_lane_fields(spark, sf):
    return _fields_lanes(spark, sf)[0]


def s_lane_fields(s):
    return f"SELECT row_id, key, lane, task FROM {_fields_lanes_sql(s)}"


def q_lane_load(spark, sf):
    d, pa = _fields_lanes(spark, sf)
    return lanes.lane_load(d, pa)


def s_lane_load(s):
    return f"SELECT lane, count(*) AS rows, CAST(min(task) AS BIGINT) AS task FROM {_fields_lanes_sql(s)} GROUP BY lane"


# ---------------------------------------------------------------- windows


def q_count_window(spark, sf):
    _, (sp, wc) = _topo_of("TimerSpout", "WindowedPathBolt")
    return windows.count_window(spout(inbound_from(spark, sf, by_time=True), sp), wc, 10).select("row_id", "lane", "win", "pos")


def s_count_window(s):
    sp = O.spout(s, O.Comp("TimerSpout", 0))
    w = O.count_window(s, sp, O.Comp("WindowedPathBolt", 1), 10)
    return f"SELECT row_id, lane, win, pos FROM {w}"


def _pathbolt_then(spark, sf, name):
    _, (sp, pb, wc) = _topo_of("TimerSpout", "PathBolt", name)
    return messages.path_bolt(spout(inbound_from(spark, sf, by_time=True), sp), pb), wc


def _pathbolt_then_sql(s, name):
    sp = O.spout(s, O.Comp("TimerSpout", 0))
    return O.path_bolt(s, sp, O.Comp("PathBolt", 1)), O.Comp(name, 2)


def q_window_emit_all(spark, sf):
    d, wc = _pathbolt_then(spark, sf, "WindowedPathBolt")
    return msg_out(windows.emit_all(d, wc, 10), "win")


def s_window_emit_all(s):
    d, wc = _pathbolt_then_sql(s, "WindowedPathBolt")
    return f"SELECT {MSG_SQL}, win FROM {O.emit_all(s, d, wc, 10)}"


def q_window_emit_by_spout(spark, sf):
    d, wc = _pathbolt_then(spark, sf, "WindowedPathBolt")
    return msg_out(windows.emit_by_spout(d, wc, 10), "win", "spout_task")


def s_window_emit_by_spout(s):
    d, wc = _pathbolt_then_sql(s, "WindowedPathBolt")
    return f"SELECT {MSG_SQL}, win, spout_task FROM {O.emit_by_spout(s, d, wc, 10)}"


def _window_stage(spark, sf, group_by):
    _, (sp, wc) = _topo_of("TimerSpout", "WindowedPathBolt")
    return windows.emit_one(spout(inbound_from(spark, sf, by_time=True), sp), wc, 10, create_path_msg=True, group_by=group_by)


def q_window_emit_one(spark, sf):
    return msg_out(_window_stage(spark, sf, "tuple"), "win")


def s_window_emit_one(s):
    return f"SELECT {MSG_SQL}, win FROM {O.p_window(s, upto='window')}"


def q_window_emit_one_by_path(spark, sf):
    return msg_out(_window_stage(spark, sf, "path"), "win")


def s_window_emit_one_by_path(s):
    return f"SELECT {MSG_SQL}, win FROM {O.p_window(s, group_by='path', upto='window')}"


def _fish_front(spark, sf):
    t = synthetic()
    sp = t.component("TimerSpout")
    pb, pm = t.component("PathBolt"), t.component("PathMultiplier")
    s = spout(inbound_from(spark, sf, by_time=True), sp, num_streams=2)
    return P.fork_path_and_multiplier(s, Routed({"kafkaMessages0": pb, "kafkaMessages1": pm}), pm), t


def q_join_split(spark, sf):
    front, t = _fish_front(spark, sf)
    return msg_out(windows.join_split(front, t.component("JoinSplitBolt"), 20), "win", "source_stream")


def s_join_split(s):
    return f"SELECT {MSG_SQL}, win, source_stream FROM {O.p_fish(s, upto='window')}"


def q_join_split_time(spark, sf):
    front, t = _fish_front(spark, sf)
    return msg_out(windows.join_split_time(front, t.component("JoinSplitBolt"), 2000), "win", "source_stream")


def s_join_split_time(s):
    return f"SELECT {MSG_SQL}, win, source_stream FROM {O.p_fish(s, upto='window', time_window_ms=2000)}"


# ---------------------------------------------------------------- metrics


def _corrupt_accepted(spark, sf):
    return validate.accepted(validate.validate_payload(_corrupt_rows(spark, sf)))


def _corrupt_accepted_sql(s):
    v = O.validated(s, _corrupt_rows_sql(s))
    return s.add(f"SELECT * FROM {v} WHERE reject_reason IS NULL", "acc")


def q_kafka_latency(spark, sf):
    return metrics.kafka_latency(_corrupt_accepted(spark, sf))


def s_kafka_latency(s):
    a = _corrupt_accepted_sql(s)
    return (f"SELECT 'measured-kafka-latency' AS measurement, spout_component, spout_task, "
            f"kafka_ts - originTimestamp AS value, array_to_string(path, '>') AS path FROM {a}")


def q_end2end_latency(spark, sf):
    return metrics.end2end_latency(_corrupt_accepted(spark, sf))


def s_end2end_latency(s):
    a = _corrupt_accepted_sql(s)
    return (f"SELECT 'measured-end2end-latency' AS measurement, spout_component, spout_task, sink_component, sink_task, "
            f"stormMilliLatencyMs AS ms_latency_ms, array_to_string(path, '>') AS path FROM {a}")


POINT_COLS = "measurement, spout_component, spout_task, sink_component, sink_task, value, ms_latency_ms, path"


def q_metric_points(spark, sf):
    return metrics.metric_points(validate.accepted(_clean_receiver(spark, sf)))


def s_metric_points(s):
    v = _clean_receiver_sql(s)
    a = s.add(f"SELECT * FROM {v} WHERE reject_reason IS NULL", "acc")
    return f"SELECT {POINT_COLS} FROM {O.points(s, a)}"


def _fish_accepted(spark, sf):
    return validate.accepted(_clean_receiver(spark, sf, P.fish))


def _fish_accepted_sql(s):
    v = _clean_receiver_sql(s, O.p_fish)
    return s.add(f"SELECT * FROM {v} WHERE reject_reason IS NULL", "acc")


def q_throughput_by_count(spark, sf):
    return metrics.throughput_by_count(_fish_accepted(spark, sf), n=500, order_cols=("kafka_ts", "row_id", "sink"))


def s_throughput_by_count(s, n=500):
    a = _fish_accepted_sql(s)
    r = s.add(f"SELECT partition, kafka_ts, row_number() OVER (PARTITION BY partition ORDER BY kafka_ts, row_id, sink) AS rn "
              f"FROM {a}", "tr")
    m = s.add(f"SELECT partition, rn, kafka_ts AS t FROM {r} WHERE rn = 1 OR rn % {n + 1} = 0", "tm")
    lg = s.add(f"SELECT *, lag(t) OVER (PARTITION BY partition ORDER BY rn) AS start_ms FROM {m}", "tl")
    return (
        f"SELECT partition, CAST(rn // {n + 1} AS BIGINT) AS report_no, CAST({n} AS BIGINT) AS messages, "
        f"CAST(start_ms AS BIGINT) AS start_ms, CAST(t AS BIGINT) AS end_ms, CAST(t - start_ms AS BIGINT) AS elapsed_ms, "
        f"CASE WHEN t - start_ms > 0 THEN CAST({n} AS DOUBLE) * CAST(1000.0 AS DOUBLE) / CAST(t - start_ms AS DOUBLE) END "
        f"AS rate_mps FROM {lg} WHERE rn % {n + 1} = 0"
    )


def q_throughput_by_time(spark, sf):
    return metrics.throughput_by_time(_fish_accepted(spark, sf), 2000)


def s_throughput_by_time(s):
    a = _fish_accepted_sql(s)
    return (f"SELECT kafka_ts // 2000 * 2000 AS bucket_start_ms, count(*) AS messages, "
            f"CAST(count(*) AS DOUBLE) * CAST(1000.0 AS DOUBLE) / CAST(2000.0 AS DOUBLE) AS rate_mps FROM {a} GROUP BY 1")


def _transfers_q(name):
    def run(spark, sf):
        return metrics.transfer_latency(P.transfer_rows(name, inbound_from(spark, sf, by_time=name in WINDOWED), synthetic()), 2000)
    return run


def _transfers_s(name):
    def build(s):
        return (
            "SELECT component, task, recv_ms // 2000 * 2000 AS bucket_start_ms, "
            "count(*) AS transfers, CAST(sum(transfer_ms) AS BIGINT) AS sum_ms, max(transfer_ms) AS max_ms, "
            f"CAST(sum(transfer_ms) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_ms "
            f"FROM {O.pipeline_transfers(s, name)} GROUP BY 1, 2, 3"
        )
    return build


def q_quarantine_rows(spark, sf):
    return validate.quarantined(validate.validate_payload(_corrupt_rows(spark, sf))).select(
        "row_id", "sink", "reject_reason", "value")


def s_quarantine_rows(s):
    return (f"SELECT row_id, sink, reject_reason, value FROM {O.validated(s, _corrupt_rows_sql(s))} "
            f"WHERE reject_reason IS NOT NULL")


# ---------------------------------------------------------------- pipelines


def _pipeline_q(fn, by_time=False):
    def run(spark, sf):
        return sent_out(fn(inbound_from(spark, sf, by_time), synthetic()), _value().alias("value"))
    return run


def _pipeline_s(fn):
    def build(s):
        return f"SELECT {SENT_SQL}, {O.payload_json()} AS value FROM {fn(s)}"
    return build


def q_pipeline_receiver(spark, sf):
    return metrics.metric_points(_corrupt_accepted(spark, sf))


def s_pipeline_receiver(s):
    return f"SELECT {POINT_COLS} FROM {O.points(s, _corrupt_accepted_sql(s))}"


def q_pipeline_round_trip(spark, sf):
    return P.round_trip(inbound_from(spark, sf, by_time=True), synthetic())


def s_pipeline_round_trip(s):
    return f"SELECT {POINT_COLS} FROM {O.points(s, _fish_accepted_sql(s))}"


REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], Callable[[O.Sql], str] | None]] = {
    "spout_ingest": (q_spout_ingest, s_spout_ingest),
    "spout_multi_stream": (q_spout_multi_stream, s_spout_multi_stream),
    "mint_message_id": (q_mint_message_id, s_mint_message_id),
    "path_create": (q_path_create, s_path_create),
    "path_append": (q_path_append, s_path_append),
    "parse_payload": (q_parse_payload, s_parse_payload),
    "serialise_payload": (q_serialise_payload, s_serialise_payload),
    "path_endpoints": (q_path_endpoints, s_path_endpoints),
    "path_string": (q_path_string, s_path_string),
    "spout_task": (q_spout_task, s_spout_task),
    "path_bolt": (q_path_bolt, s_path_bolt),
    "path_adder": (q_path_adder, s_path_adder),
    "send_stage": (q_send_stage, s_send_stage),
    "filter_timestamp_type": (q_filter_timestamp_type, s_filter_timestamp_type),
    "validate_payload": (q_validate_payload, s_validate_payload),
    "reject_counts": (q_reject_counts, s_reject_counts),
    "weighted_key": (q_weighted_key, s_weighted_key),
    "key_distribution": (q_key_distribution, s_key_distribution),
    "normal_multiplier": (q_normal_multiplier, s_normal_multiplier),
    "multiplier_distribution": (q_multiplier_distribution, s_multiplier_distribution),
    "fanout_normal": (q_fanout_normal, s_fanout_normal),
    "fanout_fixed": (q_fanout_fixed, s_fanout_fixed),
    "split_streams": (q_split_streams, s_split_streams),
    "lane_shuffle": (q_lane_shuffle, s_lane_shuffle),
    "lane_fields": (q_lane_fields, s_lane_fields),
    "lane_load": (q_lane_load, s_lane_load),
    "count_window": (q_count_window, s_count_window),
    "window_emit_all": (q_window_emit_all, s_window_emit_all),
    "window_emit_by_spout": (q_window_emit_by_spout, s_window_emit_by_spout),
    "window_emit_one": (q_window_emit_one, s_window_emit_one),
    "window_emit_one_by_path": (q_window_emit_one_by_path, s_window_emit_one_by_path),
    "join_split": (q_join_split, s_join_split),
    "join_split_time": (q_join_split_time, s_join_split_time),
    "kafka_latency": (q_kafka_latency, s_kafka_latency),
    "end2end_latency": (q_end2end_latency, s_end2end_latency),
    "metric_points": (q_metric_points, s_metric_points),
    "throughput_by_count": (q_throughput_by_count, s_throughput_by_count),
    "throughput_by_time": (q_throughput_by_time, s_throughput_by_time),
    "transfer_latency": (_transfers_q("basic"), _transfers_s("basic")),
    "transfer_latency_multi": (_transfers_q("multi"), _transfers_s("multi")),
    "transfer_latency_window": (_transfers_q("window"), _transfers_s("window")),
    "transfer_latency_fish": (_transfers_q("fish"), _transfers_s("fish")),
    "transfer_latency_all": (_transfers_q("all"), _transfers_s("all")),
    "quarantine_rows": (q_quarantine_rows, s_quarantine_rows),
    "pipeline_basic": (_pipeline_q(P.basic), _pipeline_s(O.p_basic)),
    "pipeline_f2f": (_pipeline_q(P.f2f), _pipeline_s(O.p_f2f)),
    "pipeline_multi": (_pipeline_q(P.multi), _pipeline_s(O.p_multi)),
    "pipeline_window": (_pipeline_q(P.window, by_time=True), _pipeline_s(O.p_window)),
    "pipeline_fish": (_pipeline_q(P.fish, by_time=True), _pipeline_s(O.p_fish)),
    "pipeline_all": (_pipeline_q(P.all_in_one, by_time=True), _pipeline_s(O.p_all)),
    "pipeline_receiver": (q_pipeline_receiver, s_pipeline_receiver),
    "pipeline_round_trip": (q_pipeline_round_trip, s_pipeline_round_trip),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: _sql(v[1]) for k, v in REGISTRY.items() if v[1] is not None}

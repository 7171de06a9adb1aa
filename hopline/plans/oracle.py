"""DuckDB oracle SQL for every registered query.

The same semantics as the Spark operators, written independently as SQL over
the raw tables: one CTE per stage, ``row_number`` windows where Spark uses
sliced ranking, ``row_number() = 1`` where Spark uses ``min_by``.
Every draw is the same salted md5 as ``hopline.functions.draws``.
"""

from __future__ import annotations

from dataclasses import dataclass

SEED = 42
LANES = 16

# --- fixed values: keys with their cumulative weights in 32nds, and the standard normal CDF at -9 .. 10, written out so
# that an error in the engine's tables shows ---
KEYS = ["A", "B", "C", "D", "E", "F", "G", "H", "I", "J", "K", "L", "M", "N", "O", "P"]
KEY_CUMULATIVE_32 = [6, 10, 13, 16, 18, 20, 22, 24, 25, 26, 27, 28, 29, 30, 31, 32]
FALLBACK_KEY = "A"
NORMAL_CDF_MINUS_9_TO_10 = [
    1.1285884059538422e-19, 6.220960574271819e-16, 1.279812543885835e-12, 9.865876450377012e-10,
    2.866515718791946e-07, 3.1671241833119965e-05, 0.0013498980316300957, 0.02275013194817922,
    0.15865525393145707, 0.5, 0.8413447460685429, 0.9772498680518208,
    0.9986501019683699, 0.9999683287581669, 0.9999997133484281, 0.9999999990134123,
    0.9999999999987201, 0.9999999999999993, 1.0, 1.0,
]
# --- end of fixed values ---


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def H(*parts: str) -> str:
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5(concat_ws('|', {joined})), 1, 8)) AS BIGINT)"


def U(*parts: str) -> str:
    return f"(CAST({H(*parts)} AS DOUBLE) / CAST(4294967296.0 AS DOUBLE))"


def dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def first_at_least(u: str, cumulative, values, fallback) -> str:
    whens = " ".join(
        f"WHEN {u} <= {dbl(c)} THEN {q(v) if isinstance(v, str) else v}" for c, v in zip(cumulative, values)
    )
    fb = q(fallback) if isinstance(fallback, str) else fallback
    return f"(CASE {whens} ELSE {fb} END)"


def key_of(u: str) -> str:
    return first_at_least(u, [c / 32 for c in KEY_CUMULATIVE_32], KEYS, FALLBACK_KEY)


def multiplier_of(u: str) -> str:
    """1 .. 20 around 10 with deviation 1; 0 if none is reached."""
    return f"CAST({first_at_least(u, NORMAL_CDF_MINUS_9_TO_10, range(1, 21), 0)} AS BIGINT)"


def java_double(x: str) -> str:
    """Java's Double.toString for the integral, non-negative doubles latencies are."""
    digits = f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"
    mant = f"rtrim({digits}, '0')"
    sci = (
        f"(CASE WHEN length({mant}) = 1 THEN {mant} || '.0' "
        f"ELSE substr({mant}, 1, 1) || '.' || substr({mant}, 2) END) || 'E' || CAST(length({digits}) - 1 AS VARCHAR)"
    )
    return f"(CASE WHEN {x} >= 10000000 THEN {sci} ELSE {digits} || '.0' END)"


def payload_json(mid="messageID", org="originTimestamp", lat="stormMilliLatencyMs", path="path") -> str:
    """JSON text of a path message in declared field order; a field given as None is left out."""
    parts = []
    if mid is not None:
        parts.append(f"'\"messageID\":' || to_json({mid})")
    if org is not None:
        parts.append(f"'\"originTimestamp\":' || CAST({org} AS VARCHAR)")
    if lat is not None:
        parts.append(f"'\"stormMilliLatencyMs\":' || {java_double(lat)}")
    if path is not None:
        parts.append(f"'\"path\":' || to_json({path})")
    return "('{' || " + " || ',' || ".join(parts) + " || '}')"


JUNK = "junk"


@dataclass
class Comp:
    name: str
    index: int

    @property
    def name_sql(self) -> str:
        return q(self.name)

    def task(self, lane: str = "lane") -> str:
        return f"({self.index * LANES + 1} + {lane})"

    def element(self, lane: str = "lane") -> str:
        return f"({q(self.name + ':')} || CAST({self.task(lane)} AS VARCHAR))"


class Routed:
    def __init__(self, routes: dict[str, Comp]):
        self.routes = routes
        self.name_sql = "(CASE " + " ".join(f"WHEN stream = {q(s)} THEN {q(c.name)}" for s, c in routes.items()) + " END)"
        self.index_sql = "(CASE " + " ".join(f"WHEN stream = {q(s)} THEN {c.index}" for s, c in routes.items()) + " END)"

    def task(self, lane: str = "lane") -> str:
        return f"({self.index_sql} * {LANES} + 1 + {lane})"

    def element(self, lane: str = "lane") -> str:
        return f"({self.name_sql} || ':' || CAST({self.task(lane)} AS VARCHAR))"


class Topo:
    def __init__(self):
        self.names: list[str] = []

    def component(self, name: str) -> Comp:
        self.names.append(name)
        return Comp(name, len(self.names) - 1)


class Sql:
    """Accumulates CTEs; ``add`` returns the new CTE's name."""

    def __init__(self):
        self.ctes: list[tuple[str, str]] = []

    def add(self, body: str, hint: str = "s") -> str:
        name = f"{hint}{len(self.ctes)}"
        self.ctes.append((name, body))
        return name

    def final(self, select: str) -> str:
        if not self.ctes:
            return select
        withs = ",\n".join(f"{n} AS (\n{b}\n)" for n, b in self.ctes)
        return f"WITH {withs}\n{select}"


def transfer_cols(comp) -> str:
    return (
        f"{comp.name_sql} AS component, CAST({comp.task()} AS BIGINT) AS task, CAST(_now AS BIGINT) AS recv_ms, "
        f"CAST(_now - timestamp AS BIGINT) AS transfer_ms"
    )


def transfers(s: Sql, src: str, comp, grouping: str = "shuffle") -> str:
    """One row for every tuple that the stage takes from ``src``."""
    return s.add(f"SELECT {transfer_cols(comp)} FROM {receive(s, src, comp, grouping)}", "tr")


def window_transfers(s: Sql, src: str, comp, n: int) -> str:
    """One row for every tuple of a full window, received when it fires."""
    w = count_window(s, src, comp, n)
    r = s.add(f"SELECT *, max(timestamp) OVER (PARTITION BY lane, win) AS _mx FROM {w}", "tw")
    f = s.add(f"SELECT *, {window_now(comp)} AS _now FROM {r}", "tf")
    return s.add(f"SELECT {transfer_cols(comp)} FROM {f}", "tr")


def draw_key(comp, row_id="row_id") -> str:
    return key_of(U(str(SEED), comp.name_sql, "'key'", row_id))


# ---------------------------------------------------------------- stages


def spout(s: Sql, comp: Comp, num_streams: int = 1) -> str:
    ev = s.add(
        "SELECT CAST(event_id AS VARCHAR) AS row_id, CAST(event_id AS BIGINT) AS event_id, "
        "epoch_us(ts) // 1000 AS msg_ts, "
        "concat_ws('-', substr(md5(CAST(event_id AS VARCHAR)), 1, 8), substr(md5(CAST(event_id AS VARCHAR)), 9, 4), "
        "substr(md5(CAST(event_id AS VARCHAR)), 13, 4), substr(md5(CAST(event_id AS VARCHAR)), 17, 4), "
        "substr(md5(CAST(event_id AS VARCHAR)), 21, 12)) AS uuid FROM events",
        "ev",
    )
    lanes = s.add(
        f"SELECT *, {H(str(SEED), comp.name_sql, chr(39) + 'lane' + chr(39), 'row_id')} % {LANES} AS lane, "
        f"msg_ts + {H('row_id', q('entry'))} % 20 AS entry FROM {ev}",
        "sl",
    )
    streams = ", ".join(q(f"kafkaMessages{i}") for i in range(num_streams))
    stream = f"unnest([{streams}])" if num_streams > 1 else q("kafkaMessages0")
    return s.add(
        f"SELECT row_id, event_id, msg_ts, {stream} AS stream, CAST(0 AS BIGINT) AS copy, lane, entry AS timestamp, "
        f"uuid, entry AS entryMilliTimestamp, msg_ts AS messageTimestamp, {comp.element()} AS path FROM {lanes}",
        "sp",
    )


def lane_expr(comp, grouping: str = "shuffle") -> str:
    field = "row_id" if grouping == "shuffle" else "key"
    return f"{H(str(SEED), comp.name_sql, q('lane'), field)} % {LANES}"


def receive(s: Sql, src: str, comp, grouping: str = "shuffle") -> str:
    """Lane and ``_now``, like ``messages.receive``."""
    a = s.add(f"SELECT * REPLACE ({lane_expr(comp, grouping)} AS lane) FROM {src}", "rl")
    return s.add(f"SELECT *, timestamp + {H('row_id', comp.name_sql, q('clock'))} % 50 AS _now FROM {a}", "rn")


def created(s: Sql, src: str, comp) -> str:
    """P1 on spout tuples."""
    return s.add(
        f"SELECT * EXCLUDE (uuid, messageTimestamp, path), uuid AS messageID, messageTimestamp AS originTimestamp, "
        f"CAST(0.0 AS DOUBLE) AS stormMilliLatencyMs, [path, {comp.element()}] AS path FROM {src}",
        "pc",
    )


FRAME = (
    "row_id, event_id, msg_ts, stream, copy, lane, timestamp, key, entryMilliTimestamp, "
    "messageID, originTimestamp, stormMilliLatencyMs, path"
)


def path_bolt(s: Sql, src: str, comp: Comp, grouping="shuffle", out_stream="pathMessages") -> str:
    c = created(s, receive(s, src, comp, grouping), comp)
    return s.add(
        f"SELECT * EXCLUDE (_now, stream, timestamp), {q(out_stream)} AS stream, _now AS timestamp, "
        f"{draw_key(comp)} AS key FROM {c}",
        "pb",
    )


def path_adder(s: Sql, src: str, comp: Comp, grouping="fields", out_stream="pathAddedMessages") -> str:
    r = receive(s, src, comp, grouping)
    return s.add(
        f"SELECT * EXCLUDE (_now, stream, timestamp, key, path), {q(out_stream)} AS stream, _now AS timestamp, "
        f"{draw_key(comp)} AS key, list_append(path, {comp.element()}) AS path FROM {r}",
        "pa",
    )


def send(s: Sql, src: str, comp, grouping="shuffle") -> str:
    r = receive(s, src, comp, grouping)
    return s.add(
        f"SELECT * EXCLUDE (_now, timestamp, stormMilliLatencyMs, path), _now AS timestamp, "
        f"CAST(_now - entryMilliTimestamp AS DOUBLE) AS stormMilliLatencyMs, "
        f"list_append(path, {comp.element()}) AS path, {comp.name_sql} AS sink, "
        f"_now + {H('row_id', q('append'))} % 30 AS append_ms FROM {r}",
        "sd",
    )


def fanout(s: Sql, src: str, comp: Comp, count_sql: str, out_stream: str) -> str:
    c = created(s, receive(s, src, comp), comp)
    m = s.add(f"SELECT *, {count_sql} AS _m FROM {c}", "fm")
    e = s.add(
        f"SELECT * EXCLUDE (copy, _m), CAST(unnest(range(0, _m)) AS BIGINT) AS copy FROM {m} WHERE _m > 0", "fe"
    )
    r = s.add(
        f"SELECT * EXCLUDE (_now, stream, timestamp, row_id), row_id || ':' || CAST(copy AS VARCHAR) AS row_id, "
        f"{q(out_stream)} AS stream, _now AS timestamp FROM {e}",
        "fr",
    )
    return s.add(f"SELECT *, {draw_key(comp)} AS key FROM {r}", "fk")


def mult_draw(comp: Comp) -> str:
    return multiplier_of(U(str(SEED), comp.name_sql, q("mult"), "row_id"))


def count_window(s: Sql, src: str, comp: Comp, n: int) -> str:
    a = s.add(f"SELECT * REPLACE ({lane_expr(comp)} AS lane) FROM {src}", "wl")  # lane = pick hash % lanes
    b = s.add(
        f"SELECT *, row_number() OVER (PARTITION BY lane ORDER BY msg_ts, event_id, stream, copy, row_id) AS pos, "
        f"count(*) OVER (PARTITION BY lane) AS _cnt FROM {a}",
        "wr",
    )
    return s.add(f"SELECT * EXCLUDE (_cnt), (pos - 1) // {n} AS win FROM {b} WHERE pos <= (_cnt // {n}) * {n}", "wc")


def window_now(comp: Comp, mx: str = "_mx") -> str:
    return f"{mx} + {H('lane', 'win', comp.name_sql, q('clock'))} % 50"


def emit(comp: Comp, out_stream: str, entry: str, origin: str) -> str:
    """Window output columns from a picked row (columns in scope, ``_now`` set)."""
    return (
        f"row_id, event_id, msg_ts, {q(out_stream)} AS stream, copy, lane, _now AS timestamp, "
        f"{draw_key(comp)} AS key, CAST({entry} AS BIGINT) AS entryMilliTimestamp, messageID, "
        f"CAST({origin} AS BIGINT) AS originTimestamp, stormMilliLatencyMs, "
        f"list_append(path, {comp.element()}) AS path, win"
    )


def pick_order(comp: Comp) -> str:
    """Random pick in a window: the window component's lane hash (full value), then row_id."""
    return f"{H(str(SEED), comp.name_sql, q('lane'), 'row_id')}, row_id"


def emit_one(s: Sql, src: str, comp: Comp, n: int, create_path_msg=False, group_by="tuple", out_stream="pathMessages") -> str:
    w = count_window(s, src, comp, n)
    if create_path_msg:
        w = created(s, w, comp)
    if group_by == "tuple":
        r = s.add(
            f"SELECT *, max(timestamp) OVER (PARTITION BY lane, win) AS _mx, "
            f"row_number() OVER (PARTITION BY lane, win ORDER BY {pick_order(comp)}) AS _k FROM {w}",
            "w4",
        )
        p = s.add(f"SELECT *, {window_now(comp)} AS _now FROM {r} WHERE _k = 1", "w4p")
        return s.add(f"SELECT {emit(comp, out_stream, 'entryMilliTimestamp', 'entryMilliTimestamp')} FROM {p}", "w4o")
    r = s.add(
        f"SELECT *, array_to_string(path, ' ') AS _ps, max(timestamp) OVER (PARTITION BY lane, win) AS _mx FROM {w}",
        "wb",
    )
    g = s.add(
        f"SELECT *, count(*) OVER (PARTITION BY lane, win, _ps) AS _pc, "
        f"sum(entryMilliTimestamp) OVER (PARTITION BY lane, win, _ps) AS _psum, "
        f"row_number() OVER (PARTITION BY lane, win, _ps ORDER BY pos) AS _first FROM {r}",
        "wg",
    )
    f = s.add(
        f"SELECT *, row_number() OVER (PARTITION BY lane, win ORDER BY "
        f"{H(str(SEED), comp.name_sql, q('path'), 'lane', 'win', '_ps')}, _ps) AS _k FROM {g} WHERE _first = 1",
        "wf",
    )
    p = s.add(f"SELECT *, CAST(_psum // _pc AS BIGINT) AS _avg, {window_now(comp)} AS _now FROM {f} WHERE _k = 1", "wp")
    return s.add(f"SELECT {emit(comp, out_stream, '_avg', '_avg')} FROM {p}", "wo")


def emit_all(s: Sql, src: str, comp: Comp, n: int, out_stream="pathMessages") -> str:
    w = count_window(s, src, comp, n)
    r = s.add(f"SELECT *, max(timestamp) OVER (PARTITION BY lane, win) AS _mx FROM {w}", "w2")
    p = s.add(f"SELECT *, {window_now(comp)} AS _now FROM {r}", "w2n")
    return s.add(f"SELECT {emit(comp, out_stream, 'originTimestamp', 'originTimestamp')} FROM {p}", "w2o")


def spout_task_sql(path: str = "path") -> str:
    return f"TRY_CAST(string_split({path}[1], ':')[2] AS BIGINT)"


def emit_by_spout(s: Sql, src: str, comp: Comp, n: int, out_stream="pathMessages") -> str:
    w = count_window(s, src, comp, n)
    r = s.add(
        f"SELECT *, {spout_task_sql()} AS spout_task, max(timestamp) OVER (PARTITION BY lane, win) AS _mx FROM {w}",
        "w3",
    )
    g = s.add(
        f"SELECT *, count(*) OVER (PARTITION BY lane, win, spout_task) AS _pc, "
        f"sum(entryMilliTimestamp) OVER (PARTITION BY lane, win, spout_task) AS _psum, "
        f"row_number() OVER (PARTITION BY lane, win, spout_task ORDER BY {pick_order(comp)}) AS _k FROM {r}",
        "w3g",
    )
    p = s.add(f"SELECT *, CAST(_psum // _pc AS BIGINT) AS _avg, {window_now(comp)} AS _now FROM {g} WHERE _k = 1", "w3p")
    return s.add(f"SELECT {emit(comp, out_stream, '_avg', '_avg')}, spout_task FROM {p}", "w3o")


def join_split_core(s: Sql, w: str, comp: Comp, out1: str, out2: str, now_sql: str) -> str:
    r = s.add(
        f"SELECT *, array_to_string(path, ' ') AS _ps, max(timestamp) OVER (PARTITION BY lane, win) AS _mx FROM {w}",
        "j0",
    )
    g = s.add(
        f"SELECT *, count(*) OVER (PARTITION BY lane, win, stream, _ps) AS _pc, "
        f"sum(originTimestamp) OVER (PARTITION BY lane, win, stream, _ps) AS _psum, "
        f"row_number() OVER (PARTITION BY lane, win, stream, _ps ORDER BY {pick_order(comp)}) AS _k FROM {r}",
        "j1",
    )
    f = s.add(
        f"SELECT *, row_number() OVER (PARTITION BY lane, win, stream ORDER BY "
        f"{H(str(SEED), comp.name_sql, q('path'), 'lane', 'win', 'stream', '_ps')}, _ps) AS _k2 FROM {g} WHERE _k = 1",
        "j2",
    )
    p = s.add(
        f"SELECT *, CAST(_psum // _pc AS BIGINT) AS _avg, {now_sql} AS _now, stream AS source_stream "
        f"FROM {f} WHERE _k2 = 1",
        "j3",
    )
    o = s.add(f"SELECT {emit(comp, out1, '_avg', '_avg')}, source_stream FROM {p}", "j4")
    return s.add(f"SELECT * REPLACE (unnest([{q(out1)}, {q(out2)}]) AS stream) FROM {o}", "j5")


def join_split(s: Sql, src: str, comp: Comp, n: int, out1="Stream3", out2="Stream4") -> str:
    w = count_window(s, src, comp, n)
    return join_split_core(s, w, comp, out1, out2, window_now(comp))


def join_split_time(s: Sql, src: str, comp: Comp, window_ms: int = 2000, out1="Stream3", out2="Stream4") -> str:
    w = s.add(
        f"SELECT * REPLACE ({lane_expr(comp)} AS lane), "
        f"(timestamp + {H('row_id', comp.name_sql, q('clock'))} % 50) // {window_ms} AS win FROM {src}",
        "jt",
    )
    return join_split_core(s, w, comp, out1, out2, f"(win + 1) * {window_ms}")


def fork_fish(s: Sql, src: str, pb: Comp, pm: Comp) -> str:
    routed = Routed({"kafkaMessages0": pb, "kafkaMessages1": pm})
    c = created(s, receive(s, src, routed), routed)
    is_path = "stream = 'kafkaMessages0'"
    m = s.add(f"SELECT *, CASE WHEN {is_path} THEN CAST(1 AS BIGINT) ELSE {mult_draw(pm)} END AS _m FROM {c}", "ff")
    e = s.add(
        f"SELECT * EXCLUDE (copy, _m), CAST(unnest(range(0, _m)) AS BIGINT) AS copy FROM {m} WHERE _m > 0", "fe"
    )
    r = s.add(
        f"SELECT * EXCLUDE (_now, stream, timestamp, row_id), "
        f"CASE WHEN {is_path} THEN row_id ELSE row_id || ':' || CAST(copy AS VARCHAR) END AS row_id, "
        f"CASE WHEN {is_path} THEN 'Stream1' ELSE 'Stream2' END AS stream, stream AS _in, _now AS timestamp FROM {e}",
        "fr",
    )
    routed_in = Routed({"kafkaMessages0": pb, "kafkaMessages1": pm})
    key = key_of(U(str(SEED), routed_in.name_sql.replace("stream =", "_in ="), q("key"), "row_id"))
    return s.add(f"SELECT * EXCLUDE (_in), {key} AS key FROM {r}", "fk")


# ---------------------------------------------------------------- pipelines


def p_basic(s: Sql) -> str:
    t = Topo()
    sp = spout(s, t.component("TimerSpout"))
    pb = path_bolt(s, sp, t.component("PathBolt"))
    return send(s, pb, t.component("SenderBolt"))


def p_f2f(s: Sql, upto: str = "send") -> str:
    t = Topo()
    sp = spout(s, t.component("TimerSpout"))
    pb = path_bolt(s, sp, t.component("PathBolt"))
    pa = path_adder(s, pb, t.component("PathAdderBolt"), grouping="fields")
    if upto == "adder":
        return pa
    return send(s, pa, t.component("SenderBolt"), grouping="fields")


def p_multi(s: Sql, copies: int = 10, upto: str = "send") -> str:
    t = Topo()
    sp = spout(s, t.component("TimerSpout"))
    mc = t.component("MultiPathBolt")
    m = fanout(s, sp, mc, f"CAST({copies} AS BIGINT)", "pathMessages")
    if upto == "fanout":
        return m
    return send(s, m, t.component("SenderBolt"))


def p_window(s: Sql, n: int = 10, group_by: str = "tuple", upto: str = "send") -> str:
    t = Topo()
    sp = spout(s, t.component("TimerSpout"))
    w = emit_one(s, sp, t.component("WindowedPathBolt"), n, create_path_msg=True, group_by=group_by)
    if upto == "window":
        return w
    return send(s, w, t.component("SenderBolt"))


def pipeline_transfers(s: Sql, name: str) -> str:
    """All tuples that the stages of a pipeline receive: counted from each stage's input."""
    t = Topo()
    sp = spout(s, t.component("TimerSpout"), num_streams=2 if name == "fish" else 1)
    if name == "basic":
        pb, sd = t.component("PathBolt"), t.component("SenderBolt")
        parts = [transfers(s, sp, pb), transfers(s, path_bolt(s, sp, pb), sd)]
    elif name == "multi":
        mc, sd = t.component("MultiPathBolt"), t.component("SenderBolt")
        parts = [transfers(s, sp, mc), transfers(s, p_multi(s, upto="fanout"), sd)]
    elif name == "window":
        wc, sd = t.component("WindowedPathBolt"), t.component("SenderBolt")
        parts = [window_transfers(s, sp, wc, 10), transfers(s, p_window(s, upto="window"), sd)]
    elif name == "fish":
        pb, pm, js = t.component("PathBolt"), t.component("PathMultiplier"), t.component("JoinSplitBolt")
        senders = Routed({"Stream3": t.component("SenderBoltA"), "Stream4": t.component("SenderBoltB")})
        parts = [transfers(s, sp, Routed({"kafkaMessages0": pb, "kafkaMessages1": pm})),
                 window_transfers(s, p_fish(s, upto="front"), js, 20), transfers(s, p_fish(s, upto="window"), senders)]
    else:
        mc, wc, sd = t.component("MultiPathBolt"), t.component("WindowedPathBolt"), t.component("SenderBolt")
        m = fanout(s, sp, mc, "CAST(20 AS BIGINT)", "Stream2")
        parts = [transfers(s, sp, mc), window_transfers(s, m, wc, 10),
                 transfers(s, emit_one(s, m, wc, 10, out_stream="Stream3"), sd)]
    return s.add(" UNION ALL ".join(f"SELECT * FROM {p}" for p in parts), "ta")


def p_fish(s: Sql, n: int = 20, upto: str = "send", time_window_ms: int | None = None) -> str:
    t = Topo()
    sp = spout(s, t.component("TimerSpout"), num_streams=2)
    pb, pm = t.component("PathBolt"), t.component("PathMultiplier")
    front = fork_fish(s, sp, pb, pm)
    if upto == "front":
        return front
    js = t.component("JoinSplitBolt")
    j = join_split_time(s, front, js, time_window_ms) if time_window_ms else join_split(s, front, js, n)
    if upto == "window":
        return j
    senders = Routed({"Stream3": t.component("SenderBoltA"), "Stream4": t.component("SenderBoltB")})
    return send(s, j, senders)


def p_all(s: Sql, copies: int = 20, n: int = 10) -> str:
    t = Topo()
    sp = spout(s, t.component("TimerSpout"))
    m = fanout(s, sp, t.component("MultiPathBolt"), f"CAST({copies} AS BIGINT)", "Stream2")
    w = emit_one(s, m, t.component("WindowedPathBolt"), n, out_stream="Stream3")
    return send(s, w, t.component("SenderBolt"))


def outbound(s: Sql, sent: str, corrupt: bool = False, partitions: int = 4) -> str:
    """Receiver input rows (value text, kafka_ts, timestampType, partition) from sender rows."""
    part = f"CAST({H(str(SEED), q('afterStorm'), q('partition'), 'sink', 'row_id')} % {partitions} AS INTEGER)"
    if not corrupt:
        return s.add(
            f"SELECT {payload_json()} AS value, append_ms AS kafka_ts, 1 AS timestampType, {part} AS partition, "
            f"CAST(-1 AS BIGINT) AS offset, row_id, sink FROM {sent}",
            "ob",
        )
    c = f"({H('row_id', q('bad'))} % 25)"
    n = "len(path)"
    first = lambda e: f"list_concat([{q(e)}], path[2:{n}])"
    last = lambda e: f"list_concat(path[1:{n} - 1], [{q(e)}])"
    value = (
        f"CASE WHEN {c} = 0 THEN '{{bad' "
        f"WHEN {c} = 1 THEN {payload_json(org=None)} "
        f"WHEN {c} = 2 THEN {payload_json(lat=None)} "
        f"WHEN {c} = 3 THEN {payload_json(path=None)} "
        f"WHEN {c} = 4 THEN {payload_json(path='CAST([] AS VARCHAR[])')} "
        f"WHEN {c} = 5 THEN {payload_json(path=first('A:1:2'))} "
        f"WHEN {c} = 6 THEN {payload_json(path=last('B'))} "
        f"WHEN {c} = 7 THEN {payload_json(path=first('A:x'))} "
        f"WHEN {c} = 8 THEN NULL "
        f"WHEN {c} = 9 THEN '' "
        f"WHEN {c} = 10 THEN {payload_json(path=f'list_concat(path[1:1], [{q(JUNK)}], path[3:{n}])')} "
        f"WHEN {c} = 11 THEN {payload_json(path='path[1:1]')} "
        f"WHEN {c} = 12 THEN {payload_json()} || ' x' "
        f"WHEN {c} = 13 THEN {payload_json()} || {payload_json()} "
        f"WHEN {c} = 14 THEN replace({payload_json()}, '\"', chr(39)) "
        f"WHEN {c} = 15 THEN {payload_json(path=f'list_concat(path[1:1], [NULL], path[3:{n}])')} "
        f"WHEN {c} = 16 THEN replace({payload_json(path=f'list_concat(path[1:1], [{q(JUNK)}], path[3:{n}])')}, '\"junk\"', '5') "
        f"ELSE {payload_json()} END"
    )
    t = f"({H('row_id', q('tstype'))} % 20)"
    tstype = f"CASE WHEN {t} = 0 THEN -1 WHEN {t} = 1 THEN 0 WHEN {t} = 2 THEN NULL ELSE 1 END"
    return s.add(
        f"SELECT {value} AS value, CASE WHEN {t} <> 3 THEN append_ms END AS kafka_ts, {tstype} AS timestampType, {part} AS partition, "
        f"CAST(-1 AS BIGINT) AS offset, row_id, sink FROM {sent}",
        "oc",
    )


def validated(s: Sql, rows: str) -> str:
    a = s.add(
        f"SELECT *, COALESCE(CASE WHEN json_valid(value) THEN json_type(value) END = 'OBJECT', false) AS _obj FROM {rows}",
        "v0",
    )
    b = s.add(
        "SELECT *, "
        "CASE WHEN _obj THEN json_extract_string(value, '$.messageID') END AS messageID, "
        "CASE WHEN _obj AND json_type(value, '$.originTimestamp') IN ('BIGINT', 'UBIGINT') "
        "THEN CAST(json_extract(value, '$.originTimestamp') AS BIGINT) END AS originTimestamp, "
        "CASE WHEN _obj AND json_type(value, '$.stormMilliLatencyMs') IN ('DOUBLE', 'BIGINT', 'UBIGINT') "
        "THEN CAST(json_extract(value, '$.stormMilliLatencyMs') AS DOUBLE) END AS stormMilliLatencyMs, "
        "CASE WHEN _obj AND json_type(value, '$.path') = 'ARRAY' "
        f"THEN CAST(json_extract(value, '$.path') AS VARCHAR[]) END AS path FROM {a}",
        "v1",
    )
    c = s.add(
        "SELECT *, string_split(path[1], ':') AS _f, string_split(path[len(path)], ':') AS _l FROM " + b, "v2"
    )
    d = s.add(
        "SELECT *, _f[1] AS spout_component, TRY_CAST(_f[2] AS BIGINT) AS spout_task, "
        f"_l[1] AS sink_component, TRY_CAST(_l[2] AS BIGINT) AS sink_task FROM {c}",
        "v3",
    )
    return s.add(
        "SELECT * EXCLUDE (_obj, _f, _l), CASE "
        "WHEN timestampType IS NULL OR timestampType = -1 OR kafka_ts IS NULL THEN 'no_timestamp' "
        "WHEN timestampType <> 1 THEN 'not_log_append' "
        "WHEN value IS NULL THEN 'null_value' "
        "WHEN NOT _obj THEN 'bad_json' "
        "WHEN originTimestamp IS NULL THEN 'missing_origin' "
        "WHEN stormMilliLatencyMs IS NULL THEN 'missing_latency' "
        "WHEN path IS NULL THEN 'missing_path' "
        "WHEN len(path) = 0 THEN 'empty_path' "
        "WHEN list_distinct(json_type(value, '$.path[*]')) <> ['VARCHAR'] THEN 'bad_element' "
        "WHEN len(_f) <> 2 OR len(_l) <> 2 THEN 'bad_endpoint' "
        "WHEN spout_task IS NULL OR sink_task IS NULL THEN 'non_integer_task' "
        f"END AS reject_reason FROM {d}",
        "v4",
    )


def points(s: Sql, acc: str) -> str:
    return s.add(
        "SELECT 'measured-kafka-latency' AS measurement, spout_component, spout_task, CAST(NULL AS VARCHAR) AS sink_component, "
        "CAST(NULL AS BIGINT) AS sink_task, kafka_ts - originTimestamp AS value, CAST(NULL AS DOUBLE) AS ms_latency_ms, "
        f"array_to_string(path, '>') AS path FROM {acc} "
        "UNION ALL SELECT 'measured-end2end-latency', spout_component, spout_task, sink_component, sink_task, "
        f"CAST(NULL AS BIGINT), stormMilliLatencyMs, array_to_string(path, '>') FROM {acc}",
        "mp",
    )

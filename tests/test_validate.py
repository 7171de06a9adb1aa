import json

from hopline.operators import validate
from hopline.operators.metrics import metric_points
from hopline.plans import pipelines as P
from hopline.sources.fixtures import corrupt_payload
from hopline.sources.kafka import events_as_inbound
from tests.conftest import make_events, synthetic

GOOD = {"messageID": "m-1", "originTimestamp": 1704067207179, "stormMilliLatencyMs": 12.0,
        "path": ["TimerSpout:3", "PathBolt:20", "SenderBolt:41"]}


def _with(**kw):
    d = dict(GOOD)
    for k, v in kw.items():
        if v is None:
            d.pop(k)
        else:
            d[k] = v
    return json.dumps(d)


CASES = [
    ("ok", _with(), 1, None),
    ("no_ts", _with(), -1, "no_timestamp"),
    ("create_ts", _with(), 0, "not_log_append"),
    ("ts_first", "{bad", 0, "not_log_append"),
    ("bad", "{bad", 1, "bad_json"),
    ("empty", "", 1, "bad_json"),
    ("array", "[1, 2]", 1, "bad_json"),
    ("null", None, 1, "null_value"),
    ("no_origin", _with(originTimestamp=None), 1, "missing_origin"),
    ("frac_origin", _with(originTimestamp=1.5), 1, "missing_origin"),
    ("no_latency", _with(stormMilliLatencyMs=None), 1, "missing_latency"),
    ("no_path", _with(path=None), 1, "missing_path"),
    ("empty_path", _with(path=[]), 1, "empty_path"),
    ("first_3_parts", _with(path=["A:1:2", "B:2"]), 1, "bad_endpoint"),
    ("last_1_part", _with(path=["A:1", "B"]), 1, "bad_endpoint"),
    ("first_not_int", _with(path=["A:x", "B:2"]), 1, "non_integer_task"),
    ("last_not_int", _with(path=["A:1", "B:y"]), 1, "non_integer_task"),
    ("middle_junk", _with(path=["A:1", "junk", "B:2"]), 1, None),
    ("one_element", _with(path=["A:7"]), 1, None),
    ("no_type", _with(), None, "no_timestamp"),
    ("trailing", _with() + " x", 1, "bad_json"),
    ("two_objects", _with() + _with(), 1, "bad_json"),
    ("two_in_a_row", _with() + ", " + _with(), 1, "bad_json"),
    ("single_quotes", _with().replace('"', "'"), 1, "bad_json"),
    ("null_element", _with(path=["A:1", None, "B:2"]), 1, "bad_element"),
    ("numeric_element", _with(path=["A:1", 5, "B:2"]), 1, "bad_element"),
    ("object_element", _with(path=["A:1", {"x": 1}, "B:2"]), 1, "bad_element"),
    ("space_around", "  " + _with() + " ", 1, None),
]


def test_every_reason(spark):
    rows = [(name, v, 1704067207300, t, 0, i) for i, (name, v, t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "name string, value string, kafka_ts bigint, timestampType int, partition int, offset bigint")
    got = {r.name: r.reject_reason for r in validate.validate_payload(df).collect()}
    assert got == {name: reason for name, _, _, reason in CASES}


def test_a_missing_record_time_is_rejected(spark):
    df = spark.createDataFrame([("x", _with(), None, 1, 0, 0)],
                               "name string, value string, kafka_ts bigint, timestampType int, partition int, offset bigint")
    row = validate.validate_payload(df).first()
    assert row.reject_reason == "no_timestamp" and validate.quarantined(validate.validate_payload(df)).first().value == _with()


def test_one_element_path_is_spout_and_sink(spark):
    df = spark.createDataFrame([("x", _with(path=["A:7"]), 1704067207300, 1, 0, 0)],
                               "name string, value string, kafka_ts bigint, timestampType int, partition int, offset bigint")
    pts = metric_points(validate.accepted(validate.validate_payload(df))).collect()
    assert len(pts) == 2
    e2e = [p for p in pts if p.measurement == "measured-end2end-latency"][0]
    assert (e2e.spout_component, e2e.spout_task, e2e.sink_component, e2e.sink_task) == ("A", 7, "A", 7)
    kafka = [p for p in pts if p.measurement == "measured-kafka-latency"][0]
    assert kafka.value == 1704067207300 - 1704067207179 and kafka.ms_latency_ms is None


def test_corruption_fixture_counts(spark):
    out = P.basic(events_as_inbound(make_events(spark, 2000)), synthetic())
    v = P.receiver(corrupt_payload(out))
    counts = {r.outcome: r.rows for r in validate.reject_counts(v).collect()}
    assert sum(counts.values()) == 2000
    assert counts["accepted"] > 500
    for reason in ["no_timestamp", "not_log_append", "bad_json", "missing_origin", "missing_latency",
                   "missing_path", "empty_path", "bad_element", "bad_endpoint", "non_integer_task", "null_value"]:
        assert counts.get(reason, 0) > 0, reason
    # quarantine + accepted is a partition of the input
    assert validate.accepted(v).count() + validate.quarantined(v).count() == 2000

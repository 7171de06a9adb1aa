"""Small slices (as on large inputs) give the same pipeline results as large ones, on the same plan."""

import re

from pyspark.sql import functions as F

from hopline.functions.clock import SyntheticClock
from hopline.plans import pipelines as P
from hopline.plans.topology import Topology
from hopline.sources.kafka import events_as_inbound
from tests.conftest import SF_SMALL

COLS = ["row_id", "stream", "lane", "timestamp", "key", "entryMilliTimestamp", "originTimestamp", "append_ms"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS, F.array_join("path", ">").alias("p")).collect())


def test_slice_sizes_change_nothing(spark):
    inb = events_as_inbound(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    for build in (P.fish, P.all_in_one, lambda i, t, **kw: P.window(i, t, group_by="path", **kw)):
        large = build(inb, Topology(clock=SyntheticClock()))
        small = build(inb, Topology(clock=SyntheticClock()), target_rows=3, width_ms=3_600_000)
        for df in (large, small):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert re.search(r"hashpartitioning\(lane#\d+L, _s0#\d+L", plan)  # finer slices only where spans are crowded
        assert _rows(small) == _rows(large)

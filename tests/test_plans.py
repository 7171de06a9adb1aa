"""Physical-plan checks: pruning reaches the scan, no Python in batch plans, exchange counts."""

import re

from hopline.plans import catalog
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(catalog.queries()["pipeline_basic"](spark, SF_SMALL))
    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))
    assert schemas == {"struct<event_id:bigint,ts:timestamp_ntz>"}


def test_no_python_in_batch_plans(spark):
    for name in ["pipeline_basic", "pipeline_fish", "pipeline_all", "pipeline_receiver", "throughput_by_count"]:
        plan = _plan(catalog.queries()[name](spark, SF_SMALL))
        assert "Python" not in plan and "ArrowEval" not in plan, name


def test_stateless_pipeline_has_no_shuffle(spark):
    plan = _plan(catalog.queries()["pipeline_f2f"](spark, SF_SMALL))
    assert "Exchange" not in plan and "SortMergeJoin" not in plan and "Window" not in plan


def test_join_split_exchanges(spark):
    plan = _plan(catalog.queries()["join_split"](spark, SF_SMALL))
    # one exchange of the rows by (lane, slice) for the rank, one by (lane, win) for all later steps
    by_win = re.findall(r"Exchange hashpartitioning\(lane#\d+L, win#\d+L", plan)
    assert len(by_win) == 1 and "_s0" in plan
    assert "SortAggregate" not in plan


def test_one_random_pick_has_no_sort_aggregate(spark):
    for name in ("window_emit_one", "pipeline_window", "pipeline_all"):
        plan = _plan(catalog.queries()[name](spark, SF_SMALL))
        assert "SortAggregate" not in plan and "trace" not in plan, name


def test_nothing_is_broadcast_by_force(spark):
    for name in ("count_window", "pipeline_all", "throughput_by_count"):
        df = catalog.queries()[name](spark, SF_SMALL)
        assert "broadcast" not in df._jdf.queryExecution().analyzed().toString().lower(), name


def test_every_registered_query_scans_the_given_tables(spark):
    for name, q in catalog.queries().items():
        plan = q(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        # the count report ranks what the pipeline before it wrote
        assert ("hopline-table" if name == "throughput_by_count" else "events.parquet") in plan, name
        if name != "key_distribution":  # its 16-row expected-weights table is the only literal input
            assert "LocalTableScan" not in plan, name

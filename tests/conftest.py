import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def synthetic(**options):
    """A topology on the deterministic clock."""
    from hopline.functions.clock import SyntheticClock
    from hopline.plans.topology import Topology

    return Topology(clock=SyntheticClock(), **options)


@pytest.fixture(scope="session")
def spark():
    from hopline.session import local_session

    s = local_session("*", 8, app="hopline-tests")
    yield s


def make_events(spark, n, start=datetime(2024, 1, 1), step_ms=1000, first_id=0):
    """A tiny events-shaped table (event_id, ts) with strictly increasing times."""
    from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

    rows = [(first_id + i, start + timedelta(milliseconds=i * step_ms)) for i in range(n)]
    schema = StructType([StructField("event_id", LongType()), StructField("ts", TimestampNTZType())])
    return spark.createDataFrame(rows, schema)

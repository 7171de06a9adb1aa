"""The receiver stores rejected rows unless told not to."""
import os

import pytest
from pyspark.sql import functions as F

from hopline.run import run
from tests.test_streaming import SF_SMALL


@pytest.mark.parametrize("stream", [False, True])
def test_rejected_rows_are_stored_by_default(spark, tmp_path, stream):
    src, out = str(tmp_path / "in"), str(tmp_path / "points")
    run(spark, "basic", f"{SF_SMALL}/events.parquet", str(tmp_path / "basic"), synthetic_clock=True)
    rows = spark.read.parquet(str(tmp_path / "basic")).limit(20)
    rows.withColumn("value", F.lit("no json").cast(rows.schema["value"].dataType)).write.parquet(src)
    run(spark, "receiver", src, out, stream=stream, checkpoint=str(tmp_path / "ck"))
    assert spark.read.parquet(out + "_rejected").count() == 20
    run(spark, "receiver", src, out + "2", stream=stream, checkpoint=str(tmp_path / "ck2"), keep_rejected=False)
    assert not os.path.exists(out + "2_rejected")

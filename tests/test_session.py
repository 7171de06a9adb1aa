import os

from hopline.session import cut_lineage, ensure_checkpoint_dir, remove_written_tables


def test_written_tables_are_removed(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file://")
    kept = set(os.listdir(folder))
    df = cut_lineage(spark.range(10))
    assert df.count() == 10
    assert "hopline-table-" in df._jdf.queryExecution().executedPlan().toString()
    remove_written_tables()
    assert not {f for f in os.listdir(folder) if f.startswith("hopline-table-")} - kept

"""Session helpers: a local session for tests and a shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "hopline") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.driver.memory", os.environ.get("HOPLINE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the deployment and only read here.
    Only when it is unset (local tests) do we pick a scratch folder of our own.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder; a machine-local folder "
                               "does not survive a lost executor")
        conf_dir = tempfile.mkdtemp(prefix="hopline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Used before operators that read their input several times (a stats pass, a
    count pass and the main pass), so an expensive upstream runs once, and so a
    lost executor re-reads the written table instead of recomputing the upstream.
    A plain write computes the input once (an RDD checkpoint would compute it twice).
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hopline-table-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(remove_written_tables)
    getattr(_step, "written", _written).append((spark, path))
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


_written: list[tuple[SparkSession, str]] = []
_step = threading.local()


@contextlib.contextmanager
def tables_of_a_step():
    """Tables that ``cut_lineage`` writes inside go when it ends (a micro-batch): no result may read them afterwards."""
    outer = getattr(_step, "written", None)
    _step.written = own = []
    try:
        yield
    finally:
        if outer is None:
            del _step.written
        else:
            _step.written = outer
        _remove(own)


def remove_written_tables() -> None:
    """Remove the tables that ``cut_lineage`` wrote in this process; runs by itself when the driver ends.

    Call it earlier only when no result that reads them is needed any more.
    """
    _remove(_written)


def _remove(written: list[tuple[SparkSession, str]]) -> None:
    while written:
        spark, path = written.pop()
        if spark.sparkContext._jsc is None:  # the session has ended: its folder is the deployment's to clean
            continue
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

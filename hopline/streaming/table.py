"""Tables that a stream appends to batch by batch, each batch visible whole or not at all (O2, stream state, side outputs).

A batch is written to ``<path>/batch_id=<id>/attempt=<name>`` and counts once the empty file ``_commits/<id>.<name>`` exists, which is
created in one step. A replayed batch is a new attempt: readers of ``read`` see the old one until its commit and the new one from then on; then the
other attempts go. A writer killed at any point leaves an attempt without a commit, which no such reader sees and the replay removes.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

COMMITS = "_commits"


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}" if folder else self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def committed(self) -> dict[int, str]:
        """Folder of each committed batch; of two committed attempts the later one."""
        out: dict[int, str] = {}
        for name in sorted(n for n in self._names(COMMITS) if "." in n and not n.startswith(".")):
            batch, attempt = name.split(".", 1)
            out[int(batch)] = f"{self.path}/batch_id={int(batch)}/attempt={attempt}"
        return out

    def write(self, rows: DataFrame, batch_id: int, *partition_by: str) -> None:
        attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        w = rows.write.mode("error")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.path}/batch_id={batch_id}/attempt={attempt}")
        self._fs.mkdirs(self._path(f"{self.path}/{COMMITS}"))
        self._fs.createNewFile(self._path(f"{self.path}/{COMMITS}/{batch_id:012d}.{attempt}"))
        self._drop(batch_id, keep=attempt)

    def _drop(self, batch_id: int, keep: str | None = None) -> None:
        for name in self._names(COMMITS):  # first the commits: what has none is seen by no reader
            if name.startswith(f"{batch_id:012d}.") and name != f"{batch_id:012d}.{keep}":
                self._fs.delete(self._path(f"{self.path}/{COMMITS}/{name}"), False)
        for name in self._names(f"batch_id={batch_id}"):
            if name != f"attempt={keep}":
                self._fs.delete(self._path(f"{self.path}/batch_id={batch_id}/{name}"), True)
        if keep is None:
            self._fs.delete(self._path(f"{self.path}/batch_id={batch_id}"), True)

    def forget_before(self, batch_id: int) -> None:
        """Remove the batches before ``batch_id`` (old state)."""
        for batch in self.committed():
            if batch < batch_id:
                self._drop(batch)

    def read(self, *batches: int) -> DataFrame | None:
        """The committed rows, of the given batches only if there are any; None if nothing is committed, or no row of a partitioned table."""
        folders = [f for b, f in self.committed().items() if not batches or b in batches]
        filled = [f for f in folders if any(not n.startswith(("_", ".")) for n in self._names(f.removeprefix(f"{self.path}/")))]
        if not filled:
            return None
        return self.spark.read.option("basePath", self.path).parquet(*filled).drop("batch_id", "attempt")

    def read_before(self, batch_id: int) -> DataFrame | None:
        """The rows of the last committed batch before ``batch_id``: the state that this batch starts from, replayed or not."""
        earlier = [b for b in self.committed() if b < batch_id]
        return self.read(max(earlier)) if earlier else None

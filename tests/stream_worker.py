"""Helper process for the kill-and-recover test: runs the windowed stream until killed."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hopline.functions.clock import SyntheticClock  # noqa: E402
from hopline.plans.topology import Topology  # noqa: E402
from hopline.session import local_session  # noqa: E402
from hopline.sources.kafka import events_as_inbound  # noqa: E402
from hopline.streaming import pipelines as S  # noqa: E402


def main(src, out, ckpt, schema_path):
    spark = local_session(2, 4, app="hopline-stream-worker")
    schema = spark.read.parquet(schema_path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    w, finish = S.window_stream(events_as_inbound(stream), Topology(clock=SyntheticClock()))
    q = S.run_to_table(w, finish, out, ckpt, processingTime="2 seconds")
    q.awaitTermination()


if __name__ == "__main__":
    main(*sys.argv[1:5])

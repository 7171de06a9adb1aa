"""hopline: provenance-tracing message pipelines and latency analytics on Spark.

Every operator is a DataFrame -> DataFrame function (usable with ``df.transform``).
Randomness and wall clocks are replaced by salted md5 draws and an explicit clock,
so that batch, streaming and SQL oracle results agree row for row.
"""

from hopline.plans.topology import Component, Topology  # noqa: F401
from hopline.functions.clock import SyntheticClock, WallClock  # noqa: F401

__all__ = ["Component", "Topology", "SyntheticClock", "WallClock"]

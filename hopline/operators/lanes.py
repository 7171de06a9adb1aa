"""Groupings (X1-X3): which task of a component receives a row.

Shuffle grouping spreads rows by a salted hash of the row id; fields grouping
sends equal keys to the same task. Both only compute a ``lane`` column: no
physical repartition happens unless a window or aggregate needs one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.functions.draws import hash32
from hopline.plans.topology import Component, name_col


def shuffle_lane(comp: Component) -> Column:
    """Lane from the row id."""
    return hash32(comp.seed, name_col(comp), "lane", F.col("row_id")) % comp.lanes


def fields_lane(comp: Component, field: str = "key") -> Column:
    """Lane from a field, so equal values share a task."""
    return hash32(comp.seed, name_col(comp), "lane", F.col(field)) % comp.lanes


def lane_for(comp: Component, grouping: str = "shuffle", field: str = "key") -> Column:
    if grouping == "shuffle":
        return shuffle_lane(comp)
    if grouping == "fields":
        return fields_lane(comp, field)
    raise ValueError(f"unknown grouping {grouping!r}")


def lane_load(df: DataFrame, comp: Component | None = None) -> DataFrame:
    """Rows per lane (and task, when the component is given)."""
    out = df.groupBy("lane").agg(F.count(F.lit(1)).alias("rows"))
    if comp is not None:
        out = out.withColumn("task", comp.task(F.col("lane")))
    return out

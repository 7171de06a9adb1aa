"""Helpers shared by the operators: whole-table readers and shipping of task code."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII white space; lower-casing touches A-Z only.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def ship(module: str) -> None:
    """Send the functions of ``module`` to tasks by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def hex64(col: Column) -> Column:
    """A 64-bit value as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def two_hashes(*cols: Column) -> list[Column]:
    """Two independent 64-bit digests of the columns (null is a value of its own), for equality joins on wide values."""
    told = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(*told).alias("_h1"), F.xxhash64(F.lit(7919), *told).alias("_h2")]

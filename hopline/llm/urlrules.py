"""URL filters by a sort-merge range join of urls and (host, path) rules.

A rule fits its host and all subdomains if the url's path starts with the rule's; the longest rule wins.

*Canonical keys.* A rule whose host has d labels becomes the key ``d|reversed labels//path``, and a url becomes
one such key for each depth that occurs among the rules and that its host reaches. A rule fits a url
exactly if its key is a prefix of the url's key of that depth, so every rule is an interval of sorted keys, and
intervals nest or are disjoint.

*Sweep.* Urls and rules are dealt to key ranges and sorted in each. One pass keeps the stack of the rules whose interval is
open; its top is the longest that fits. A rule goes to each range that its interval touches. The range limits
come from a bounded sample of the keys and only balance the work: a key as frequent as several limits is spread over
the ranges between them. No side is broadcast.

The longest of a url's depths wins: most characters of host and path, then the longer host, then the greater text.
A rule given twice counts once, with the greater verdict (block). Null urls and urls without ``://`` have empty host and
path and get the default verdict. Repeated rows stay repeated.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.llm.common import ship

SAMPLE = 16  # keys sampled for each range; only balances the ranges
LIMIT_CHARS = 256  # a range limit needs no longer key


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def depth_key(host: Column, path: Column, depth: Column) -> Column:
    """``depth|`` and the last ``depth`` labels of the host, reversed, then ``/`` and the path."""
    labels = F.slice(F.reverse(F.split(host, r"\.")), F.lit(1), depth)
    return F.concat(depth.cast("string"), F.lit("|"), F.array_join(labels, "."), F.lit("/"), path)


def ranges_of_key(limits: Sequence[str], key: str) -> tuple[int, int]:
    """First and last range that may hold a url key: a key that is a limit several times may lie in several."""
    lo, hi = bisect_left(limits, key), bisect_right(limits, key)
    return (lo, lo) if lo == hi else (lo + 1, hi)


def ranges_of_rule(limits: Sequence[str], prefix: str) -> list[int]:
    """Every range that may hold a key with the prefix."""
    last = first = bisect_left(limits, prefix)
    while last < len(limits) and limits[last].startswith(prefix):
        last += 1
    return list(range(first, last + 1))


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (range, key), rules first: the innermost open rule for every url row."""
    stack: list[tuple[str, int, str, str]] = []  # key, characters of the host, rule, verdict
    current = None
    for batch in batches:
        page = batch["is_page"].to_numpy()
        top: list[tuple] = []
        for at, key, is_page, chars, rule, verdict in zip(
                batch["range"], batch["key"], page, batch["host_chars"], batch["rule"], batch["verdict"], strict=True):
            if at != current:
                stack, current = [], at
            while stack and (key is None or not key.startswith(stack[-1][0])):
                stack.pop()
            if is_page:
                top.append(stack[-1][1:] if stack else (None, None, None))
            else:
                stack.append((key, int(chars), rule, verdict))
        found = {c: batch[c].to_numpy(dtype=object)[page] for c in ("page", "url", "depth")}
        found |= {c: [t[i] for t in top] for i, c in enumerate(("host_chars", "rule", "verdict"))}
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in found.items()})


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, ``rule`` (host and path of the longest that fits, or null), ``verdict``.

    ``rules`` has the columns host, path and verdict.
    """
    spark = pages.sparkSession
    own = rules.select(F.lower("host").alias("host"), "path", "verdict").na.drop(subset=["host", "path"])
    own = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = own.withColumn("depth", F.size(F.split("host", r"\.")))
    depths = sorted(r["depth"] for r in own.select("depth").distinct().collect())  # at most the labels of a host name
    n_ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    url = F.col("url")
    parts = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url")).select(
        "page", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.size(F.split("host", r"\."))
    reached = F.filter(F.array(*[F.lit(d) for d in depths]).cast("array<int>"), lambda d: d <= labels)
    # depth 0: one row of every page, with no key, that keeps pages no rule can fit
    keyed = parts.select("page", "url", "host", "path", F.explode(F.concat(F.array(F.lit(0)), reached)).alias("depth"))
    keyed = keyed.select("page", "url", "depth", F.when(
        F.col("depth") > 0, depth_key(F.col("host"), F.col("path"), F.col("depth"))).alias("key"))
    by_chance = F.xxhash64("key", "page", "url")
    sample = keyed.where("key is not null").select(F.substring("key", 1, LIMIT_CHARS).alias("k"), by_chance.alias("h"))
    sample = sorted(r["k"] for r in sample.orderBy("h").limit(n_ranges * SAMPLE).collect())
    limits = [sample[len(sample) * i // n_ranges] for i in range(1, n_ranges)] if sample else []

    @F.pandas_udf("int")
    def range_of_page(keys: pd.Series, chance: pd.Series) -> pd.Series:
        out = []
        for key, c in zip(keys, chance, strict=True):
            lo, hi = (0, len(limits)) if key is None else ranges_of_key(limits, key)
            out.append(lo + c % (hi - lo + 1))
        return pd.Series(out, dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges(keys: pd.Series) -> pd.Series:
        return pd.Series([ranges_of_rule(limits, key) for key in keys])

    none = F.lit(None)
    page_rows = keyed.select(
        range_of_page("key", by_chance).alias("range"), "key", F.lit(True).alias("is_page"), "page", "url", "depth",
        none.cast("int").alias("host_chars"), none.cast("string").alias("rule"), none.cast("string").alias("verdict"))
    rule_key = depth_key(F.col("host"), F.col("path"), F.col("depth"))
    page_type, url_type = (keyed.schema[c].dataType for c in ("page", "url"))
    rule_rows = own.withColumn("key", rule_key).select(
        F.explode(ranges("key")).alias("range"), "key", F.lit(False).alias("is_page"),
        none.cast(page_type).alias("page"), none.cast(url_type).alias("url"), "depth",
        F.length("host").alias("host_chars"), F.concat("host", "path").alias("rule"), "verdict")
    rows = page_rows.unionByName(rule_rows).repartition(n_ranges, "range").sortWithinPartitions("range", "key", "is_page")
    schema = f"page {page_type.simpleString()}, url {url_type.simpleString()}, depth int, host_chars int, rule string, verdict string"
    found = rows.mapInPandas(sweep, schema)
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(
        F.length("rule").alias("chars"), "host_chars", "rule", "verdict")))
    whole = found.groupBy("page", "url").agg(best.alias("best"), F.count_if(F.col("depth") == 0).alias("times"))
    return whole.select("page", "url", "best", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(
        F.col("page").alias(id_col),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


ship(__name__)

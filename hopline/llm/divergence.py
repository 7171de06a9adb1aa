"""Source divergence audit: how far apart the sources of a language are in the terms that they use, in exact integers.

A language keeps the V terms that occur in ``least`` documents or more. A group is a (language, source); with N occurrences of
kept terms it gives a term with c of them the weight p(c) = 1 + floor(SCALE * (c + 1) / (N + V)). Divergence of a group
from another one is the sum over all kept terms of f(p, q) = floor((p - q)^2 / q) = floor(p^2 / q) - 2p + q.

Only the first part, g(p, q) = floor(p^2 / q), depends on both. A term is absent from most sources, so over all V terms
    sum g = V g(p0, q0) + sum over terms in one of both [g(p, q0) - g0] or [g(p0, q) - g0] + *pair corrections*
and a term that occurs in both groups corrects by g(p, q) - g(p, q0) - g(p0, q) + g(p0, q0), where p0 = p(0).

Pair corrections come from a *frequent-pattern tree of term rows*: a term's nonzero counts in source order are a row, equal rows
are counted first (multiplicity), and rows are inserted in sorted order, so rows that begin alike share nodes. A
node holds the multiplicity of all rows through it, and each combination of a node and one of its ancestors adds
multiplicity times correction, once. Rows are dealt to tasks by ranges of their order; a tree takes a bounded number of
items of them (however many a batch holds), and a node cut in two trees counts with the multiplicity that it has in each.

Counting: a task counts terms in a table of bounded size, then counts are summed by (language, term, source), so no group of rows
is collected; a term's row is as long as the language has sources, at most. Sums by one source run over its
distinct counts. Pairs of sources are the result itself; they are joined salted, so that one language is no single task.

Null text, language and source count as empty. Each row is a document, repeated ones too; ids are not read. A language without
kept terms gives pairs of value 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.llm.common import ship
from hopline.session import cut_lineage

SCALE = 1_000_000_000
COUNTED = 500_000  # entries of a task's table of counts
TREE_ITEMS = 1 << 18  # items of the rows of one tree, at about 200 bytes each; one row more may fit
COMBINATIONS = 1 << 17  # of nodes and ancestors looked at together, at about 250 bytes each
SALTS = 32
# bytes that occur in terms: letters A-Z (lower-cased), a-z and those of all other code points
KEPT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs) of (lang, source, text), summed as far as a bounded table goes; a group's own row has a null term."""
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    size = 0

    def told() -> Iterator[pa.RecordBatch]:
        for group, terms in counts.items():
            own = docs[group]
            for a in range(0, max(1, len(terms)), 1 << 16):
                part = list(terms)[a:a + (1 << 16)] if terms else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([group[0]] * (len(part) + (a == 0)), pa.string()), pa.array([group[1]] * (len(part) + (a == 0)), pa.string()),
                    pa.array([None] * (a == 0) + [t.decode() for t in part], pa.string()),
                    pa.array([0] * (a == 0) + [terms[t] for t in part], pa.int64()),
                    pa.array([0] * (a == 0) + [own[t] for t in part], pa.int64()),
                ], ["lang", "source", "term", "count", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            group = (lang, source)
            if group not in counts:
                counts[group], docs[group] = Counter(), Counter()
                size += 1
            whole, own = counts[group], docs[group]
            terms = Counter(text.encode().translate(KEPT).split())
            before = len(whole)
            for term, n in terms.items():
                whole[term] += n
            own.update(terms.keys())
            size += len(whole) - before
            if size > COUNTED:
                yield from told()
                counts, docs, size = {}, {}, 0
    yield from told()


def kept_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str, least: int) -> DataFrame:
    """(lang, source, term, count, whole): nonzero counts of kept terms, ``whole`` in the language; and a row of null term for each group."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    told = rows.mapInArrow(count_terms, "lang string, source string, term string, count bigint, docs bigint")
    counts = told.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term")
    spread = counts.withColumn("whole", F.sum("count").over(by_term)).withColumn("in_docs", F.sum("docs").over(by_term))
    return spread.where(F.col("term").isNull() | (F.col("in_docs") >= least)).select("lang", "source", "term", "count", "whole")


def weight(count: Column, n: Column, v: Column) -> Column:
    """p(count); null if the language has no kept term."""
    scaled = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(v > 0, F.call_function("div", scaled, (n + v).cast("decimal(20,0)")).cast("bigint") + 1)


def ratio(p: Column, q: Column) -> Column:
    """g(p, q); p is at most SCALE + 1, its square a long."""
    return F.call_function("div", p * p, q)


def group_totals(kept: DataFrame) -> DataFrame:
    """A row for each group: lang, source, code (its number in the language by code point), n, present (kept terms that occur), v and p0."""
    groups = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("term").alias("present"))
    terms = kept.where("term IS NOT NULL").select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    numbered = groups.join(terms, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("bigint"))).withColumn(
        "code", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("int"))
    return numbered.withColumn("p0", weight(F.lit(0), F.col("n"), F.col("v")))


class PatternTree:
    """Nodes of term rows that come in sorted order, in flat arrays.

    ``rows`` has row offsets; ``code``, ``count``, ``p`` and ``p0`` an entry an item; ``times`` a row's multiplicity. An item is a new node
    unless the row before begins with the same items up to and with it.
    """

    def __init__(self, offsets: np.ndarray, code: np.ndarray, count: np.ndarray, p: np.ndarray, p0: np.ndarray, times: np.ndarray):
        self.code, self.p, self.p0 = code, p, p0
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)
        depth = np.arange(len(code)) - offsets[row]
        above = np.where(row > 0, offsets[np.maximum(row - 1, 0)] + depth, 0)  # the row before at this depth
        there = (row > 0) & (depth < size[np.maximum(row - 1, 0)])
        same = there & (code == code[np.where(there, above, 0)]) & (count == count[np.where(there, above, 0)])
        shared = size.copy()  # items that a row shares with the one before
        np.minimum.at(shared, row[~same], depth[~same])
        order = np.argsort(depth, kind="stable")  # at one depth the items of a node follow each other
        new = np.flatnonzero((depth >= shared[row])[order])
        self.item = order[new]
        self.depth = depth[self.item]
        self.first = offsets[row[self.item]]  # its path: the items from here on
        self.times = np.add.reduceat(times[row[order]], new) if len(new) else np.array([], np.int64)

    def corrections(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(group code, item code, high, low) of pair corrections both ways, summed for blocks of combinations; a sum is high * 2^31 + low."""
        below = np.flatnonzero(self.depth > 0)
        upto = np.cumsum(self.depth[below])
        a = 0
        while a < len(below):
            done = upto[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(upto, done + COMBINATIONS, "right")))
            nodes, a = below[a:b], b
            many = self.depth[nodes]
            node = np.repeat(nodes, many)
            start = np.repeat(np.cumsum(many) - many, many)
            up = self.first[node] + np.arange(len(node)) - start  # the ancestors, from the root
            own, times = self.item[node], self.times[node]
            x, x0, y, y0 = self.p[up], self.p0[up], self.p[own], self.p0[own]
            pairs = []
            for p, p0, q, q0, group, item in ((x, x0, y, y0, up, own), (y, y0, x, x0, own, up)):
                square, square0 = p * p, p0 * p0
                pairs.append((self.code[group], self.code[item], square // q - square // q0 - square0 // q + square0 // q0))
            group, item, value = (np.concatenate(c) for c in zip(*pairs))
            times = np.concatenate((times, times))
            key = (group.astype(np.int64) << 32) | item
            order = np.argsort(key, kind="stable")
            key, value, times = key[order], value[order], times[order]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            # 31 bits of a value at a time, so that a sum of products stays a long
            yield (key[at] >> 32, key[at] & 0xFFFFFFFF, np.add.reduceat((value >> 31) * times, at),
                   np.add.reduceat((value & 0x7FFFFFFF) * times, at))


def tree_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, group, item, high, low) of rows (lang, row, times) in the order of (lang, row)."""
    held: list[tuple[np.ndarray, ...]] = []  # size and multiplicity of the rows, fields of their items
    items, lang = 0, None

    def told() -> Iterator[pa.RecordBatch]:
        nonlocal items
        sizes, times, *fields = (np.concatenate(c) for c in zip(*held))
        held.clear()  # the tree has copies
        items = 0
        tree = PatternTree(np.concatenate(([0], np.cumsum(sizes))), *fields, times)
        for group, item, high, low in tree.corrections():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(group), pa.string()), *(pa.array(c, pa.int64()) for c in (group, item, high, low))],
                ["lang", "group", "item", "high", "low"])

    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column(batch.schema.get_field_index("lang")).to_numpy(zero_copy_only=False)
        column = batch.column(batch.schema.get_field_index("row"))
        offsets = column.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        flat = column.flatten()
        fields = [flat.field(f).to_numpy(zero_copy_only=False) for f in ("code", "count", "p", "p0")]
        times = batch.column(batch.schema.get_field_index("times")).to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)]
        a = 0
        for end in ends:
            if held and langs[a] != lang:
                yield from told()
            lang = langs[a]
            while a < end:  # as many rows as the tree has place for, one at least
                b = int(np.searchsorted(offsets, offsets[a] + TREE_ITEMS - items, "right")) - 1
                b = min(end, max(b, a + 1))
                held.append((np.diff(offsets[a:b + 1]), times[a:b].astype(np.int64),
                             *(f[offsets[a]:offsets[b]].astype(np.int64) for f in fields)))
                items += int(offsets[b] - offsets[a])
                a = b
                if items >= TREE_ITEMS or a < end:
                    yield from told()
    if held:
        yield from told()


def pair_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's groups."""
    wide = "decimal(38,0)"
    counts = kept.where("term IS NOT NULL").join(totals.select("lang", "source", "code", "n", "v", "p0"), ["lang", "source"])
    items = counts.select("lang", "term", F.struct("code", "count", weight(F.col("count"), F.col("n"), F.col("v")).alias("p"), "p0").alias("i"))
    rows = items.groupBy("lang", "term").agg(F.array_sort(F.collect_list("i")).alias("row"))
    patterns = cut_lineage(rows.groupBy("lang", "row").agg(F.count(F.lit(1)).alias("times")))
    in_order = patterns.where(F.size("row") > 1).repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")
    corrected = in_order.mapInArrow(tree_corrections, "lang string, group bigint, item bigint, high bigint, low bigint")
    both = corrected.groupBy("lang", "group", "item").agg(
        (F.sum(F.col("high").cast(wide)) * F.lit(1 << 31).cast("decimal(10,0)") + F.sum(F.col("low").cast(wide))).cast(wide).alias("both"))

    # how many terms have a count in a source: what a sum over one source's terms needs
    tally = patterns.select("lang", "times", F.explode("row").alias("i")).groupBy("lang", F.col("i.code").alias("code"), F.col("i.p").alias("p")).agg(
        F.sum("times").alias("terms"))
    sums = tally.groupBy("lang", "code").agg(F.sum(F.col("terms").cast(wide) * F.col("p")).alias("p_sum"))
    ends = totals.join(sums, ["lang", "code"], "left").select(
        "lang", "source", "code", "v", "p0",
        (F.coalesce("p_sum", F.lit(0).cast(wide)) + (F.col("v") - F.col("present")).cast(wide) * F.coalesce("p0", F.lit(0).cast("bigint"))).alias("p_sum"))
    salted = ends.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)))
    others = ends.select("lang", *[F.col(c).alias(f"{c}2") for c in ("source", "code", "p0", "p_sum")],
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    pairs = salted.join(others, ["lang", "salt"]).where("code <> code2").drop("salt")

    # each pair meets the first source's tally; the sum serves both directions
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("p02")
    near = pairs.select("lang", "code", "code2", "p0", "p02").join(tally, ["lang", "code"])
    one = near.groupBy("lang", "code", "code2").agg(
        F.sum((ratio(p, q0) - ratio(p0, q0)).cast(wide) * F.col("terms")).alias("as_group"),
        F.sum((ratio(q0, p) - ratio(q0, p0)).cast(wide) * F.col("terms")).alias("as_item"))
    parts = one.select("lang", F.col("code").alias("group"), F.col("code2").alias("item"), F.col("as_group").cast(wide).alias("part")).unionByName(
        one.select("lang", F.col("code2").alias("group"), F.col("code").alias("item"), F.col("as_item").cast(wide).alias("part"))).unionByName(
        both.select("lang", "group", "item", F.col("both").alias("part")))
    correction = parts.groupBy("lang", "group", "item").agg(F.sum("part").alias("part")).select(
        "lang", F.col("group").cast("int").alias("code"), F.col("item").cast("int").alias("code2"), "part")
    zero = F.lit(0).cast(wide)
    value = F.col("v").cast(wide) * ratio(p0, q0) + F.coalesce("part", zero) - F.lit(2).cast(wide) * F.col("p_sum") + F.col("p_sum2")
    return pairs.join(correction, ["lang", "code", "code2"], "left").select(
        "lang", "source", F.col("source2").alias("item"), F.when(F.col("v") > 0, value).otherwise(zero).cast("bigint").alias("value"))


def term_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group uses more than its language does."""
    of_lang = totals.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    counts = kept.where("term IS NOT NULL").join(
        totals.select("lang", "source", "n", "v").join(of_lang, "lang"), ["lang", "source"])
    weighed = counts.select("lang", "source", F.col("term").alias("item"), weight(F.col("count"), F.col("n"), F.col("v")).alias("p"),
                            weight(F.col("whole"), F.col("lang_n"), F.col("v")).alias("q"))
    more = F.col("p") - F.col("q")
    return weighed.where("p > q").select("lang", "source", "item", F.call_function("div", more * more, F.col("q")).alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3,
          top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language, and the ``top`` terms of each group."""
    kept = cut_lineage(kept_terms(docs, text_col, lang_col, source_col, least))
    totals = cut_lineage(group_totals(kept))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(kept, totals).withColumn("rank", F.row_number().over(order))
    terms = term_values(kept, totals).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank")


ship(__name__)

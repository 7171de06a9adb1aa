r"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is read as units: words of up to ``UNIT`` code points whole, and of a longer run without white space the ``UNIT`` code points
at each of its places, so inside it windows slide over code points and an insertion changes only those that hold it. Hashes of ``S``
consecutive units are the inner strings; a window of ``K`` units is a *closed syncmer* if the least of its inner
hashes stands at the window's first or last place. Whether a window is chosen depends on the window alone, so an edit
elsewhere leaves the anchors of untouched passages as they are. An anchor is (place, hash of the window); a fingerprint is
the digest (128 bits) of the anchors in order, and the likeness of two texts is the Jaccard similarity of their anchor hashes.
A text without a closed syncmer (fewer than ``K`` units, or a few more) has one anchor, the hash of all its units; one
without units has the anchor 0.

*Neighbours.* A document's next is the one with the greatest id below its own (ids descending, ties by text digests, null ids
last; after the last comes the first). Rows are dealt to ranges of (id, digests): the limits are approximate quantiles of the ids, and
an id of many rows (null counts as one) has a range of its own, cut again by its rows' first digest. A window in each range
looks one row ahead, and the first row of a range is also sent to the range above, whose last row looks at it. The windows
follow the only exchange of texts. Only limits, a few for each of ``RANGES`` at most, and ranges' first rows pass through the driver.
Rows that repeat id and text have one digest and lie in one range.

Null text counts as empty. Repeated rows stay repeated and are each other's next. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.llm.common import hex64, two_hashes

K, S = 5, 2  # units in a window, in an inner string
UNIT = 8
VISIBLE = r"[^\x20\x09-\x0D]"
ROWS = 1024  # rows aimed at for each range
RANGES = 1 << 16


def units(text: Column) -> Column:
    """A match of no length at each place where a unit starts; the engine steps by UTF-16 units, and no unit starts inside a pair."""
    short, of_long = r"(?<!{0}){0}{{1,{1}}}(?!{0})".format(VISIBLE, UNIT), r"%s{%d}" % (VISIBLE, UNIT)
    return F.regexp_extract_all(text, F.lit(rf"(?!\p{{Cs}})(?=({short}|{of_long}))"), F.lit(1))


def with_anchors(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: the array of (place, hash) of the text's closed syncmers.

    Neighbouring inner hashes are paired by zipping shifted slices; every step is a column of its own, evaluated once a row.
    """
    h, inner = F.col("_units"), F.col("_inner")
    shifted = [F.slice(inner, F.lit(i + 1), F.greatest(F.size(inner) - (K - S), F.lit(0))) for i in range(K - S + 1)]
    middle = shifted[1]
    for s in shifted[2:-1]:
        middle = F.zip_with(middle, s, lambda a, b: F.least(a, b))
    edge = F.zip_with(shifted[0], shifted[-1], lambda a, b: F.least(a, b))
    window = F.zip_with(F.zip_with(shifted[0], shifted[S], lambda a, b: F.xxhash64(a, b)), shifted[-1], lambda a, b: F.xxhash64(a, b))
    marked = F.zip_with(F.zip_with(edge, middle, lambda a, b: a <= b), window, lambda chosen, w: F.when(chosen, w))
    placed = F.filter(F.transform(F.col("_marked"), lambda w, i: F.struct(i.alias("at"), w.alias("hash"))), lambda x: x["hash"].isNotNull())
    whole = F.array(F.struct(F.lit(0).alias("at"), F.when(F.size(h) > 0, F.xxhash64(F.array_join(h.cast("array<string>"), ","))).otherwise(F.lit(0).cast("bigint")).alias("hash")))
    return (
        df.withColumn("_units", F.transform(units(F.col(text_col)), lambda u: F.xxhash64(u)))
        .withColumn("_inner", F.when(F.size(h) >= K, F.zip_with(
            F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1), lambda a, b: F.xxhash64(a, b))))
        .withColumn("_marked", F.when(F.size(h) >= K, marked))
        .withColumn("_placed", placed)
        .withColumn(out, F.when(F.size("_placed") > 0, F.col("_placed")).otherwise(whole))
        .drop("_units", "_inner", "_marked", "_placed")
    )


def fingerprint(anchors: Column) -> Column:
    return F.concat(hex64(F.xxhash64(anchors)), hex64(F.xxhash64(F.lit(7919), anchors)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


# ---------------------------------------------------------- neighbours


def constant(values: list[int | None]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def limits_upto(limits: list[int], value: Column) -> Column:
    """How many of the sorted limits are at most ``value``: binary search in a constant array."""
    held = constant(limits)
    steps = [1 << i for i in range(len(limits).bit_length())][::-1]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(
        (at + s <= len(limits)) & (F.get(held, at + s - 1) <= value), at + s).otherwise(at))


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, place, _h1, _h2, guest, range): each document in its range, and the first of a range as guest in the one above."""
    place = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    ids = docs.select(place.alias("place"))
    n = ids.count()
    n_ranges = max(1, min(RANGES, n // ROWS))
    probes = [i / n_ranges for i in range(1, n_ranges)]
    aim = max(ROWS, -(-n // RANGES))
    heavy = {r["place"]: -(-r["count"] // aim) for r in ids.groupBy("place").count().where(F.col("count") > 2 * aim).collect()}
    near = ids.approxQuantile("place", probes, 0.1 / n_ranges) if probes else []
    # a range of its own for a heavy id; quantiles are doubles and may round up to 2 ** 63
    limits = sorted(x for x in {*map(int, near), *heavy, *(p + 1 for p in heavy)} if x < 1 << 63)
    cuts = [1] + [heavy.get(p, 1) for p in limits]
    base = [0, *accumulate(cuts)]

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), place.alias("place"),
                        *two_hashes(F.col(id_col), F.col(text_col)), limits_upto(limits, place).alias("at"))
    # descending ids, ascending digests: the least digests lie in an id's uppermost cut
    cut = F.get(constant(cuts), F.col("at"))
    below = F.least(F.floor((F.col("_h1").cast("double") / 2.0**64 + 0.5) * cut), cut - 1)
    rows = keyed.withColumn("own", F.get(constant(base), F.col("at")) + cut - 1 - below)
    first = F.min(F.struct(F.bitwise_not("place").alias("place"), "_h1", "_h2")).alias("first")
    tops = {r["own"]: r["first"] for r in rows.groupBy("own").agg(first).collect()}
    full = sorted(tops)  # the ranges that hold documents
    above = dict(zip(full, full[1:]))
    every = range(base[-1])

    def top(field: str) -> Column:
        return F.get(constant([tops[r][field] if r in tops else None for r in every]), F.col("own").cast("int"))

    is_top = (F.bitwise_not("place") == top("place")) & (F.col("_h1") == top("_h1")) & (F.col("_h2") == top("_h2"))
    sent = F.array(
        F.col("own"),
        F.when(is_top, F.get(constant([above.get(r) for r in every]), F.col("own").cast("int"))),
        F.when(is_top & (F.col("own") == (full[-1] if full else 0)), F.lit(full[0] if full else 0).cast("bigint")),
    )
    return rows.select("id", "text", "place", "_h1", "_h2", F.posexplode(sent).alias("guest", "range")).where("range is not null")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, next): each document's text and the text of the next document by descending id."""
    order = Window.partitionBy("range").orderBy(F.col("guest") > 0, F.desc("place"), "_h1", "_h2")
    return dealt(docs, id_col, text_col).withColumn("next", F.lead("text").over(order)).where("guest = 0").select("id", "text", "next")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is replaced by the start of the next document."""
    rows = with_next(docs, id_col, text_col)
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), n - third), F.substring("next", F.lit(1), third)))
    for text, out in (("text", "own"), ("edited", "new"), ("next", "other")):
        rows = with_anchors(rows, text, out)

    def hashes(anchors: str) -> Column:
        return F.array_distinct(F.transform(F.col(anchors), lambda a: a["hash"]))

    told = rows.select(
        F.col("id").alias(id_col), n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"),
        hashes("own").alias("a"), hashes("new").alias("b"), hashes("other").alias("c"))
    return told.select(
        id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))

"""Mixing sources to target weights, with DataFrame functions only.

1. *Targets.* Sources by code point, null last, weigh 5, 2, 1, repeating, and share ``ratio`` times all words; a target
   stops at ``most`` times its source's words and the excess is reshared by weight. That is one water level: with the
   sources sorted by cap over weight, the level is the largest of (what is left) / (weight that is left), and a
   target is the lesser of cap and level times weight.
2. *Blocks.* A source's documents form one line of words, packed into blocks of ``block`` words; a document's place is the
   running sum inside its hash bucket (of id and digests, so rows of one id are spread) plus the bucket's offset, so no source is laid out by one task.
3. *Draws.* A target of q whole sources and a rest has a quota of q slots a block and rest / block more. The mix has as many places as all
   quotas have slots; each of ``shards`` output shards holds an equal run of places, and every place draws a source by the
   quotas' shares, independently: a shard's counts by source are multinomial over its fixed number of blocks. A source's
   draws are numbered in running order of the shards. Where it drew more than its quota, a pseudorandom permutation of
   the numbers picks the draws above it, wherever they lie, and those go, in order, to the sources that drew fewer: targets are met exactly.
4. *Slots.* In each pass over a source, slot k maps to block ``permuted(k)``, a pseudorandom bijection of the block indexes.
5. *Join.* Slots and the documents' block parts meet by (source, block).

Blocks, not documents, repeat: with ``most`` = 2 no document gives more than twice its words. Draws are hashes of indexes, so reruns agree.
Null text counts as empty and has size 0. Documents of one id lie in the buckets of their digests; repeated rows are laid out one after
the other. No words at all: targets are 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.llm.common import SPACE, WORD, two_hashes
from hopline.session import cut_lineage

WEIGHTS = (5, 2, 1)
BLOCK = 64
BUCKETS = 1024  # of a source's documents, for their places
STEP = 4096  # slots that one row unfolds to
TASK_SLOTS = 1 << 17  # slots drawn or unfolded by one task
CELLS = 4096  # equal parts of the places, for finding a place's source
ROUNDS = 4


def targets(sizes: DataFrame, ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size); one row a source, so the windows over them are small."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    weighed = by_source.withColumn("weight", F.get(weights, (F.row_number().over(order) - 1) % len(WEIGHTS)))
    cap = F.col("source_size") * F.lit(float(most))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(ratio)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = weighed.withColumn("level", left / weight_left)
    level = F.max("level").over(everything)
    return leveled.select("source", "source_size", F.least(cap, level * F.col("weight")).alias("target"))


def binary_size(n: Column) -> Column:
    """Bits of a power of two that is at most n and more than half of it (or, by rounding, a quarter)."""
    bits = F.floor(F.log2(n)).cast("int")
    return F.when(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) > n, bits - 1).otherwise(bits)


def permuted(index: Column, n: Column, bits: Column, *key: Column) -> Column:
    """A bijection of 0 .. n - 1, n under 2 ** 40, chosen by ``key``; ``bits`` is ``binary_size(n)``.

    Each round scrambles the indexes under 2 ** bits (multiply by an odd number, fold the upper half down, multiply
    again) and turns the whole range by an offset: both steps are bijections.
    """
    one = F.lit(1).cast("bigint")
    keys = F.array(*[F.xxhash64(F.lit(r), *key) for r in range(ROUNDS)])

    def low(value: Column, width: Column) -> Column:
        return value.bitwiseAND(F.call_function("shiftleft", one, width) - 1)

    def odd(k: Column) -> Column:  # few enough bits for its product with an index to stay a long
        return low(k, F.least(bits, F.lit(21))).bitwiseOR(one)

    def scramble(at: Column, k: Column) -> Column:
        up = low(at * odd(k), bits)
        return low(up.bitwiseXOR(F.call_function("shiftright", up, F.lit(1) + F.call_function("shiftright", bits, F.lit(1)))) * odd(F.call_function("shiftright", k, F.lit(30))), bits)

    def step(at: Column, k: Column) -> Column:
        return (F.when(at < F.call_function("shiftleft", one, bits), scramble(at, k)).otherwise(at) + F.pmod(k, n)) % n

    return F.aggregate(keys, index, step)


def layout(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per document: id, digests of id and text, source, ``size``, and its row's place (bucket, pos, start) in the source."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    sized = cut_lineage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"),
        *two_hashes(F.col(id_col), F.col(text_col), F.col(source_col))))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("id", "_h1", "_h2"), F.lit(BUCKETS)))
    inside = Window.partitionBy("source", "bucket").orderBy("id", "_h1", "_h2")
    counts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("offset"))
    placed = sized.withColumn("pos", F.row_number().over(inside)).withColumn(
        "sum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        "id", "_h1", "_h2", "source", "size", "bucket", "pos", (F.col("offset") + F.col("sum") - F.col("size")).alias("start"))


def quotas(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each source with slots: its number ``code``, blocks ``n``, ``bits``, slots ``quota`` and ``low``, the slots of sources before it."""
    n = F.ceil(F.col("source_size") / block)
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.round((F.col("target") - whole * F.col("source_size")) / block).cast("bigint")
    quota = goals.where("source_size > 0").select(
        "source", n.alias("n"), binary_size(n).alias("bits"), (whole * n + F.least(rest, n)).alias("quota")).where("quota > 0")
    order = Window.orderBy(F.col("source").isNull(), "source")
    return quota.withColumn("code", F.row_number().over(order)).withColumn(
        "low", F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("quota"))


def located(points: DataFrame, at: str, ranges: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """``points`` with the columns of the one of ``ranges`` (disjoint: from ``low``, ``many`` long, inside 0 .. total - 1) that holds ``at``.

    An equality join on cells of the places: a range has a row in each cell that it touches, so ranges have at most
    ``CELLS`` rows more. Points without a place are spread over cells that do not exist.
    """
    width = max(1, -(-total // CELLS))
    cells = ranges.withColumn("_cell", F.explode(F.sequence(
        F.expr(f"low div {width}"), F.expr(f"(low + many - 1) div {width}")))).withColumnsRenamed({"low": "_low", "many": "_many"})
    cell = F.coalesce(F.expr(f"`{at}` div {width}"), -1 - F.pmod(F.monotonically_increasing_id(), F.lit(CELLS)))
    on = (F.col("_at") == F.col("_cell")) & (F.col(at) >= F.col("_low")) & (F.col(at) < F.col("_low") + F.col("_many"))
    return points.withColumn("_at", cell).join(cells, on, how).drop("_at", "_cell", "_low", "_many")


def shard_draws(quota: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """(shard, code, drawn): the multinomial counts by source of each shard of total / shards places."""
    tasks = max(1, -(-total // TASK_SLOTS))
    places = quota.sparkSession.range(0, total, 1, tasks).select(
        F.expr(f"(id * {shards}) div {total or 1}").alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(total or 1)).alias("x"))
    sources = quota.select("code", "low", F.col("quota").alias("many"))
    return located(places, "x", sources, total).groupBy("shard", "code").agg(F.count(F.lit(1)).alias("drawn"))


def slots(goals: DataFrame, block: int = BLOCK, shards: int = 64, seed: int = 0) -> DataFrame:
    """(source, shard, slot, block): every slot of the mix, the shard that drew it and the block of its source that fills it."""
    quota = cut_lineage(quotas(goals, block))
    total = quota.agg(F.sum("quota")).first()[0] or 0
    tasks = max(1, -(-total // TASK_SLOTS))
    draws = cut_lineage(shard_draws(quota, total, shards, seed))
    # sources that drew too many, or too few: where their surplus, or their gap, lies in the run of all of them
    counted = quota.join(draws.groupBy("code").agg(F.sum("drawn").alias("drawn")), "code", "left").withColumn(
        "drawn", F.coalesce("drawn", F.lit(0).cast("bigint")))
    counted = counted.withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).withColumn(
        "under", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
    run = Window.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    counted = cut_lineage(counted.select(
        "code", "source", "n", "bits", "quota", "drawn", "under", (F.sum("over").over(run) - F.col("over")).alias("over_low"),
        (F.sum("under").over(run) - F.col("under")).alias("under_low")))
    of_source = ("source", "n", "bits")
    gaps = counted.where("under > 0").select(
        *[F.col(c).alias(f"to_{c}") for c in of_source], (F.col("drawn") - F.col("under_low")).alias("shift"),
        F.col("under_low").alias("low"), F.col("under").alias("many"))

    # a row for some thousand draws of a source in a shard, numbered in running order; the number of tasks follows the slots, and
    # no table joins the unfolded rows but the gaps, on the right of an outer join: a plan takes the slots for few
    before = Window.partitionBy("code").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = draws.withColumn("from", F.coalesce(F.sum("drawn").over(before), F.lit(0).cast("bigint"))).withColumnRenamed("drawn", "here").join(
        counted.select("code", "quota", "drawn", "over_low", *of_source), "code")
    steps = runs.withColumn("first", F.explode(F.sequence(
        F.col("from"), F.col("from") + F.col("here") - 1, F.lit(STEP).cast("bigint")))).repartition(tasks, "shard", "code", "first")
    last = F.least(F.col("first") + STEP, F.col("from") + F.col("here")) - 1
    each = steps.withColumn("k", F.explode(F.sequence("first", last)))
    number = F.when(F.col("drawn") > F.col("quota"), permuted(
        F.col("k"), F.col("drawn"), binary_size(F.col("drawn")), F.lit(seed), F.lit("surplus"), F.col("code"))).otherwise(F.col("k"))
    numbered = each.select("shard", "quota", "over_low", *of_source, number.alias("k")).withColumn("surplus", F.when(
        F.col("k") >= F.col("quota"), F.col("over_low") + F.col("k") - F.col("quota")))
    kept = F.col("surplus").isNull()
    placed = located(numbered, "surplus", gaps, total, "left").select(
        "shard", F.when(kept, F.col("k")).otherwise(F.col("surplus") + F.col("shift")).alias("slot"),
        *[F.when(kept, F.col(c)).otherwise(F.col(f"to_{c}")).alias(c) for c in of_source])
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    turn = F.floor(F.col("slot") / F.col("n"))
    return placed.select(
        "source", "slot", "shard",
        permuted(F.col("slot") % F.col("n"), F.col("n"), F.col("bits"), F.lit(seed), source, turn).alias("block"),
    )


def shard_counts(all_slots: DataFrame) -> DataFrame:
    """Slots of each source in each output shard."""
    return all_slots.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("slots"))


def drawn_parts(placed: DataFrame, all_slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each document and block it touches (one with null block if it has no words): words ``from`` .., times drawn
    and ``shards``, the shard of each time."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    touched = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    parts = touched.withColumn("from", low - F.col("start")).withColumn("words", high - low)
    draws = all_slots.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(
        F.count(F.lit(1)).alias("times"), F.collect_list("shard").alias("shards"))
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    # slots unfold from a row a source, so a plan's size estimate is far too small: never broadcast them
    return parts.join(draws.hint("merge"), on, "left").drop("s", "b")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block: int = BLOCK, ratio: float = 1.5, most: float = 2.0, seed: int = 0, shards: int = 64) -> DataFrame:
    """One row per document: id, size, source_size, target, taken and ``shards``, the words that each of the ``shards`` takes: (shard, words)."""
    placed = cut_lineage(layout(docs, id_col, text_col, source_col))
    goals = targets(placed, ratio, most)
    parts = drawn_parts(placed, slots(goals, block, shards, seed), block)
    # rows of a document lie together for both groupings
    each = parts.select("source", "bucket", "pos", "id", "size", "words", F.explode_outer("shards").alias("shard"))
    by_shard = each.repartition("source", "bucket", "pos").groupBy("source", "bucket", "pos", "id", "size", "shard").agg(
        F.sum("words").alias("words"))
    drawn = F.col("shard").isNotNull()
    taken = by_shard.groupBy("source", "bucket", "pos", "id", "size").agg(
        F.coalesce(F.sum(F.when(drawn, F.col("words"))), F.lit(0)).cast("bigint").alias("taken"),
        F.array_sort(F.collect_list(F.when(drawn, F.struct("shard", "words")))).alias("shards"))
    goal = goals.withColumnRenamed("source", "s")
    return taken.join(goal, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken", "shards")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    length_col: str = "n_chars", block: int = BLOCK, ratio: float = 1.5, most: float = 2.0,
                    seed: int = 0, shards: int = 64, shard_col: str | None = None) -> DataFrame:
    """The mix as documents: a row for each copy of a document, its text the blocks' parts that the copy takes, in order.

    ``shard_col`` names a further column with the shard of the copy's first part: write the mix by it.

    The first copy has the parts drawn at least once, the second those drawn twice; parts keep the white space before their
    words. ``length_col`` is counted anew. Documents of which nothing is drawn go.
    """
    placed = cut_lineage(layout(docs, id_col, text_col, source_col))
    parts = drawn_parts(placed, slots(targets(placed, ratio, most), block, shards, seed), block).where("times > 0")
    draws = parts.groupBy("_h1", "_h2", "source", "bucket", "pos").agg(
        F.array_sort(F.collect_list(F.struct("from", "words", "times", F.array_sort("shards").alias("shards")))).alias("draws"))
    copies = draws.select("_h1", "_h2", "draws", F.explode(F.sequence(
        F.lit(1), F.array_max(F.transform("draws", lambda d: d["times"])).cast("int"))).alias("copy"))
    copies = copies.select("_h1", "_h2", "copy", F.filter("draws", lambda d: d["times"] >= F.col("copy")).alias("draws"))
    copies = copies.withColumn("shard", F.get(F.get("draws", F.lit(0))["shards"], F.col("copy") - 1))

    rows = docs.select(
        *two_hashes(F.col(id_col), F.col(text_col), F.col(source_col)),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).dropDuplicates(["_h1", "_h2"])
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(rf"{SPACE}*{WORD}(?:{SPACE}+\z)?"), F.lit(0))
    cut = rows.join(copies, ["_h1", "_h2"]).select("row", "draws", "shard", words.alias("words"))
    # naming the words twice keeps the optimizer from cutting the text anew for every part
    text = F.array_join(F.flatten(F.transform("draws", lambda d: F.slice(
        F.col("words"), (d["from"] + 1).cast("int"), F.least(d["words"].cast("int"), F.size("words"))))), "")
    new = cut.select("row", "shard", text.alias("text"))
    out = [] if shard_col is None else [F.col("shard").alias(shard_col)]
    return new.select(*out, *[
        F.col("text").alias(c) if c == text_col
        else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == length_col
        else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ])

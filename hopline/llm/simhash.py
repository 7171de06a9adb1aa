"""SimHash near-dedup: 64-bit fingerprints linked through BK-trees.

1. ``simhash_udf``: words of the ASCII-lower-cased text, 4-word shingles (repeats
   included), XXH64 with seed 42, majority of each bit.
2. ``linked``: distinct fingerprints are dealt to *shards*. The 64 bits are cut in
   ``radius + 2`` blocks; two fingerprints within the radius agree on two blocks at
   least, so the pair meets in the shard of (those two blocks, their bits). Each
   shard holds a BK-tree (children keyed by integer Hamming distance to the parent)
   and follows only edges within the radius. A hot shard is split in chunks of about
   ``chunk`` fingerprints, one tree each, and its fingerprints visit the trees of the
   earlier chunks. Those of every ``VISITS`` chunks get a copy of the tree, so no tree
   and no task grows with a hot group; the rows of a shard grow with its square.
   A shard answers with a spanning forest of its links, never with all pairs.
3. ``components``: alternating large-star and small-star rounds over the forest edges.

Null text counts as empty; an empty text has fingerprint zero and links like any other.
Repeated rows stay repeated. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from hopline.llm.common import ship, two_hashes
from hopline.session import cut_lineage

SEED = 42
VISITS = 4  # chunks of visitors for each copy of a tree
FLUSH = 1 << 17  # hashes held before their bits are counted


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of each word shingle; bytes.lower and bytes.split know ASCII only, as asked."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip((ends - lens)[: 1 - shingle].tolist(), ends[shingle - 1:].tolist(), strict=True)
    return [digest(line[a:b], SEED) for a, b in spans]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of ``counts`` hashes: a bit is 1 if set in over half of them."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    ones = np.stack([bits[s:s + n].sum(axis=0, dtype=np.int64) for s, n in zip(starts, counts, strict=True)])
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    held: list[int] = []
    rows: list[int] = []
    counts: list[int] = []

    def flush() -> None:
        if rows:
            out[rows] = majority(np.array(held, np.uint64), np.array(counts, np.int64))
            held.clear(), rows.clear(), counts.clear()

    for i, text in enumerate(texts):
        if hashes := shingle_hashes(text, shingle):
            held += hashes
            rows.append(i)
            counts.append(len(hashes))
        if len(held) >= FLUSH:
            flush()
    flush()
    return out


def simhash_udf(shingle: int = 4):
    """Column function: text to its fingerprint, as a signed 64-bit value."""

    @pandas_udf("bigint")
    def simhash(text: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(text.tolist(), shingle).view(np.int64))

    return simhash


# ------------------------------------------------------------- BK-trees


class BKTree:
    """Fingerprints in a tree whose children hang on edges labelled with the distance to the parent."""

    def __init__(self, prints: list[int]):
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []
        for p in prints:
            self.insert(p)

    def insert(self, p: int) -> None:
        new = len(self.prints)
        self.prints.append(p)
        self.children.append({})
        node = 0
        while node != new:
            d = (p ^ self.prints[node]).bit_count()
            node = self.children[node].setdefault(d, new)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within the radius of it): all queries go down the tree together."""
        stack = [(0, np.arange(len(queries)))] if self.prints else []
        while stack:
            node, at = stack.pop()
            d = np.bitwise_count(queries[at] ^ np.uint64(self.prints[node])).astype(np.int16)
            if len(hit := at[d <= radius]):
                yield node, hit
            for edge, child in self.children[node].items():
                if len(down := at[np.abs(d - edge) <= radius]):
                    stack.append((child, down))


def forest(tree: BKTree, queries: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between the tree's fingerprints and the queries, thinned to a spanning forest."""
    labels = np.arange(len(queries))
    where = {int(q): i for i, q in enumerate(queries)}
    edges: list[tuple[int, int]] = []
    for node, hit in tree.search(queries, radius):
        own = where[tree.prints[node]]
        new = np.unique(labels[hit])
        new = new[new != labels[own]]
        if len(new):
            first = hit[np.unique(labels[hit], return_index=True)[1]]
            edges += [(tree.prints[node], int(queries[i])) for i in first if labels[i] != labels[own]]
            labels[np.isin(labels, new)] = labels[own]
    return edges


def small_forest(prints: list[int], radius: int) -> list[tuple[int, int]]:
    """The same for a few fingerprints: insert one by one, each searching the tree so far."""
    tree, root = BKTree(prints[:1]), {p: p for p in prints}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    edges = []
    for p in prints[1:]:
        stack = [0]
        while stack:
            node = stack.pop()
            d = (p ^ tree.prints[node]).bit_count()
            if d <= radius and (a := find(p)) != (b := find(tree.prints[node])):
                root[a] = b
                edges.append((p, tree.prints[node]))
            stack += [c for e, c in tree.children[node].items() if abs(e - d) <= radius]
        tree.insert(p)
    return edges


def shard_links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (shard, chunk, visits): members of a chunk's tree come first, visitors after."""
    tree: BKTree | None = None
    held: dict[str, np.ndarray] = {}

    def answer(edges: list[tuple[int, int]]) -> pd.DataFrame:
        pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    def group(prints: np.ndarray, visits: np.ndarray) -> list[tuple[int, int]]:
        members = prints[~visits]
        if len(prints) <= 32 and len(members) == len(prints):
            return small_forest(members.tolist(), radius)
        return forest(BKTree(members.tolist()), np.concatenate([members, prints[visits]]), radius)

    def groups(frame: dict[str, np.ndarray], last: bool) -> Iterator[pd.DataFrame]:
        """Answers whole groups; what may go on in the next batch is held."""
        nonlocal held
        key, chunk = frame["shard"], frame["chunk"]
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        bounds = np.concatenate(([0], cuts, [len(key)]))
        upto = len(bounds) - 1 if last else len(bounds) - 2
        edges: list[tuple[int, int]] = []
        sizes = np.diff(bounds)
        for i in np.flatnonzero(sizes[:upto] > 1):
            s = slice(bounds[i], bounds[i + 1])
            edges += group(frame["fp"][s].view(np.uint64), frame["visits"][s])
        held = {k: v[bounds[upto]:] for k, v in frame.items()}
        yield answer(edges)

    for batch in batches:
        frame = {c: batch[c].to_numpy() for c in ("shard", "chunk", "visits", "fp")}
        if held:
            frame = {c: np.concatenate([held[c], v]) for c, v in frame.items()}
        if len(frame["fp"]):
            yield from groups(frame, False)
    if held and len(held["fp"]):
        yield from groups(held, True)


def shard_keys(fp: Column, radius: int, bits: int = 64) -> Column:
    """One key for each pair of the ``radius + 2`` blocks: which pair, and the bits of its blocks."""
    n = radius + 2
    cuts = [bits * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    width = max(b - a for a, b in zip(cuts, cuts[1:]))
    return F.array(*[
        F.lit(t << (2 * width)) + F.shiftleft(block[i], width) + block[j]
        for t, (i, j) in enumerate(combinations(range(n), 2))
    ])


def dealt(prints: DataFrame, radius: int, chunk: int) -> DataFrame:
    """Rows (shard, chunk, visits, fp): trees' members, and visitors from later chunks, ``VISITS`` chunks of them for each copy of a tree."""
    keyed = prints.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("shard"))
    hot = (
        keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
        .select(F.col("shard").alias("hot"), F.ceil(F.col("n") / chunk).alias("chunks"))
    )
    chunks = F.coalesce(F.col("chunks"), F.lit(1).cast("bigint"))
    rows = keyed.join(hot, F.col("shard") == F.col("hot"), "left").select(
        "shard", "fp", chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).alias("own"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("own"))).alias("at"))
    visits = F.col("at") < F.col("own")
    copies = F.greatest(F.lit(1).cast("bigint"), F.ceil((F.col("chunks") - 1 - F.col("at")) / VISITS))
    copy = F.pmod(F.xxhash64(F.lit(1), "fp"), copies)  # apart from the hash that chose the chunk
    rows = rows.select("shard", "fp", "chunks", "at", visits.alias("visits"), F.explode(
        F.when(visits, F.array(copy)).otherwise(F.sequence(F.lit(0).cast("bigint"), copies - 1))).alias("copy"))
    return rows.select("shard", (F.col("at") * F.col("chunks") + F.col("copy")).alias("chunk"), "visits", "fp")


def linked(prints: DataFrame, radius: int = 4, chunk: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` within ``radius`` bits that connect all that are linked."""
    rows = dealt(prints, radius, chunk).repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "visits", "fp")
    return rows.mapInPandas(lambda it: shard_links(it, radius), "a bigint, b bigint").distinct()


# ------------------------------------------------------------ components


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round on edges (a, b), a < b. Large: larger neighbours move to the least neighbour; small: smaller ones do."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("c"), F.least("a", "m").alias("m"))
    moved = both.join(least, F.col("a") == F.col("c"))
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
    else:
        out = moved.select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("c").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the least node that it reaches."""
    digest = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s"))
    edges = cut_lineage(edges.where(F.col("a") != F.col("b")))
    seen = None
    while True:
        now = edges.agg(digest.alias("d")).first()["d"]
        if now == seen or now["n"] == 0:
            break
        seen = now
        edges = cut_lineage(star(star(edges, True), False))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4, chunk: int = 4096) -> DataFrame:
    """One row per document: id, ``fp`` (signed), ``root`` (key of its component), ``component_id`` (its least id)."""
    prints = cut_lineage(docs.select(F.col(id_col).alias("id"), simhash_udf(shingle)(F.col(text_col)).alias("fp")))
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(linked(classes.select("fp"), radius, chunk))
    classes = cut_lineage(classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")))
    heads = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    found = classes.select("fp", "root").join(heads, "root")
    return prints.join(found, "fp").select(F.col("id").alias(id_col), "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each component: the one with the least (id, digests); a repeated row stays once."""
    key = two_hashes(F.col(id_col), F.col(text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    ids = docs.select(F.struct(F.col(id_col).alias("id"), *key).alias("k"), F.col(text_col).alias("t"))
    found = near_duplicates(ids, "k", "t", **options)
    heads = found.select("component_id._h1", "component_id._h2").distinct()
    return rows.join(heads, ["_h1", "_h2"]).dropDuplicates(["_h1", "_h2"]).select("row.*")


ship(__name__)

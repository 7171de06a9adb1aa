"""Approximate nearest neighbours by multiprobe p-stable hashing, largest inner product first.

*Hashing.* Vectors are scaled by the greatest norm and get one coordinate more that fills them up to norm 1, a query is scaled to
norm 1 and gets 0 there; the nearest by distance are then those of largest inner product. Each of ``tables`` tables has ``hashes`` Gaussian
projections cut in cells of ``width``; a vector's bucket is its tuple of cells.

*Probing.* For a neighbour at distance r the projections differ by Gaussians of deviation r, so the chance that it lies in a bucket
is a product over the projections of how much of the Gaussian falls in the cell. A query visits buckets in order of
that estimate until they make up ``success`` of all chances, in every table. r is read off a bounded sample.

*Search.* A table's vectors are dealt by their first cell and, where many share it, by a salt into parts of about ``part_bytes``
of components; a query goes once to each part that holds buckets it visits, multiplies with those buckets and keeps its best
of them. Tables are merged by vector and ranked by the inner product of the original vectors in double precision.
Equal vectors are searched once, as one class, and unfolded at the end: a class needs only its ``k + 1`` smallest ids.
A query's own class is one of those it finds, so ``k + 1`` are kept; one that found fewer (and not all) visits every bucket of one table in a second pass, which is exact.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id. An id that comes
with several vectors has the least of them; vectors of different lengths are not compared. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.llm.common import ship, two_hashes
from hopline.session import cut_lineage

SAMPLE_QUERIES, SAMPLE_VECTORS = 200, 4000
HELD_LENGTHS = 64


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One row per id with a usable vector: id, v (doubles), dim."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & v.isNotNull()).where(finite).where(F.exists(v, lambda x: x != 0))
        .groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    )


class Hashing:
    """The projections and cells of one vector length."""

    def __init__(self, dim: int, scale: float, radius: float, tables: int, hashes: int, width: float, success: float):
        rng = np.random.default_rng([20, dim])
        self.scale, self.radius, self.tables, self.hashes = scale, radius, tables, hashes
        self.width, self.success = width, success
        self.lines = rng.standard_normal((dim + 1, tables * hashes))
        self.shifts = rng.uniform(0, width, tables * hashes)

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Projections in units of cells, (vector, table, hash)."""
        norms = np.sqrt((x ** 2).sum(axis=1))
        if query:
            x, rest = x / norms[:, None], np.zeros(len(x))
        else:
            x = x / self.scale
            rest = np.sqrt(np.maximum(0, 1 - np.minimum(1, norms / self.scale) ** 2))
        p = (np.concatenate([x, rest[:, None]], axis=1) @ self.lines + self.shifts) / self.width
        return p.reshape(len(x), self.tables, self.hashes)

    def probes(self, p: np.ndarray) -> list[np.ndarray]:
        """For the places of each query in one table: the cells it visits, most promising first."""
        steps = np.arange(-2, 3)
        own = np.floor(p)
        low = (own[..., None] + steps - p[..., None]) * self.width / self.radius
        edge = np.vectorize(lambda z: 0.5 * (1 + erf(z / sqrt(2))))
        chance = edge(low + self.width / self.radius) - edge(low)  # (query, hash, step)
        moves = np.array(list(product(range(len(steps)), repeat=self.hashes)))
        success = np.ones((len(p), len(moves)))
        for h in range(self.hashes):
            success *= chance[:, h, moves[:, h]]
        order = np.argsort(-success, axis=1, kind="stable")
        reached = np.cumsum(np.take_along_axis(success, order, axis=1), axis=1)
        counts = 1 + (reached < self.success).sum(axis=1)
        return [own[i] + steps[moves[order[i, :c]]] for i, c in enumerate(np.minimum(counts, len(moves)))]


def pack(cells: np.ndarray) -> np.ndarray:
    """Cells as one integer: the first cell's 16 bits in front."""
    out = np.zeros(cells.shape[:-1], np.int64)
    for h in range(cells.shape[-1]):
        out = out * 4096 + (cells[..., h].astype(np.int64) + 2048)
    return out


def search_part(ids: np.ndarray, x: np.ndarray, buckets: np.ndarray, q: np.ndarray, visits: list[np.ndarray | None],
                k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of the visited buckets for each query: (query row, vector row, score). ``visits`` None: all buckets."""
    order = np.lexsort((ids, buckets))
    ids, x, buckets = ids[order], x[order], buckets[order]
    names, starts = np.unique(buckets, return_index=True)
    ends = np.append(starts[1:], len(ids))
    rows = [np.arange(len(names)) if v is None else np.flatnonzero(np.isin(names, v)) for v in visits]
    pair_query = np.repeat(np.arange(len(q)), [len(r) for r in rows])
    pair_bucket = np.concatenate(rows) if rows else np.array([], int)
    best = np.full((len(q), k), -np.inf)
    where = np.full((len(q), k), len(ids), np.int64)
    for b in np.unique(pair_bucket):
        asking = pair_query[pair_bucket == b]
        a, e = starts[b], ends[b]
        scores = q[asking] @ x[a:e].T
        at = np.broadcast_to(np.arange(a, e), scores.shape)
        if e - a > 4 * k:
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
            wide = int((scores >= kth).sum(axis=1).max())
            some = np.argsort(-scores, axis=1, kind="stable")[:, :wide]
            scores, at = np.take_along_axis(scores, some, axis=1), some + a
        rank = np.append(ids, np.iinfo(np.int64).max)
        scores, at = np.concatenate([best[asking], scores], axis=1), np.concatenate([where[asking], at], axis=1)
        keep = np.lexsort((rank[at], -scores), axis=-1)[:, :k]
        best[asking], where[asking] = np.take_along_axis(scores, keep, axis=1), np.take_along_axis(at, keep, axis=1)
    i, j = np.nonzero(np.isfinite(best))
    found = where[i, j]
    exact = np.einsum("ij,ij->i", q[i], x[found])  # one order of summation wherever the pair meets
    return i, order[found], exact


def by_length(batches: Iterator[pd.DataFrame], make: Callable[..., Hashing]) -> Iterator[tuple[Hashing, pd.DataFrame]]:
    """The rows of each vector length with its hashing; few hashings are held at a time."""
    made: dict[tuple, Hashing] = {}
    for batch in batches:
        for key, own in batch.groupby(["dim", "scale", "radius"]):
            if key not in made:
                if len(made) >= HELD_LENGTHS:
                    made.clear()
                made[key] = make(int(key[0]), float(key[1]), float(key[2]))
            yield made[key], own


def hash_rows(batches: Iterator[pd.DataFrame], make: Callable[..., Hashing]) -> Iterator[pd.DataFrame]:
    """Index rows: a vector in each table's bucket."""
    for h, own in by_length(batches, make):
        cells = np.floor(h.places(np.array(own["v"].tolist()), False))
        packed = pack(cells)
        for t in range(h.tables):
            yield pd.DataFrame({
                "dim": own["dim"].to_numpy(), "table": t, "cell": cells[:, t, 0].astype(int), "id": own["id"].to_numpy(),
                "v": own["v"].to_numpy(), "bucket": packed[:, t]})


def probe_rows(batches: Iterator[pd.DataFrame], make: Callable[..., Hashing]) -> Iterator[pd.DataFrame]:
    """Query rows: a query once for each table and first cell, with the buckets that it visits there."""
    for h, own in by_length(batches, make):
        p = h.places(np.array(own["v"].tolist()), True)
        for t in range(h.tables):
            out = []
            for dim, q, v, cells in zip(own["dim"], own["id"], own["v"], h.probes(p[:, t]), strict=True):
                packed = pack(cells)
                for c in np.unique(cells[:, 0]):
                    out.append((dim, t, int(c), q, v, packed[cells[:, 0] == c]))
            yield pd.DataFrame(out, columns=["dim", "table", "cell", "id", "v", "visits"])


def meet(batches: Iterator[pd.DataFrame], k: int, chunk: int = 512) -> Iterator[pd.DataFrame]:
    """Rows sorted by (dim, table, cell, salt), vectors before queries: each part's vectors are held, queries stream by."""
    current, held, pending = None, [], []

    def answer() -> pd.DataFrame:
        rows = pd.concat(held)
        x = np.array(rows["v"].tolist())
        q = np.array([v for _, v, _ in pending])
        i, j, score = search_part(
            rows["id"].to_numpy(np.int64), x, rows["bucket"].to_numpy(np.int64), q, [n for _, _, n in pending], k)
        names = np.array([n for n, _, _ in pending], np.int64)
        return pd.DataFrame({"query": names[i], "id": rows["id"].to_numpy(np.int64)[j], "score": score})

    for batch in batches:
        for key, own in batch.groupby(["dim", "table", "cell", "salt"], sort=False):
            if key != current:
                if held and pending:
                    yield answer()
                current, held, pending = key, [], []
            vectors_here = own[own["asks"] == 0]
            if len(vectors_here):
                held.append(vectors_here[["id", "v", "bucket"]])
            for q in own[own["asks"] == 1].itertuples():
                pending.append((q.id, q.v, None if q.visits is None else np.asarray(q.visits, np.int64)))
                if len(pending) >= chunk:
                    if held:
                        yield answer()
                    pending = []
    if held and pending:
        yield answer()


def fit(classes: DataFrame, k: int) -> DataFrame:
    """(dim, scale, radius) of each vector length: the greatest norm of all vectors, and how far the k-th neighbours of a
    bounded sample (the least hashes of the id) lie. Lengths are worked on by tasks, however many there are."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    stats = cut_lineage(classes.groupBy("dim").agg(F.max(norm).alias("scale"), F.count(F.lit(1)).alias("n")))
    place = (F.xxhash64("id").cast("double") + float(1 << 63)) / float(1 << 64)  # in the order of the hash: few rows are left to sort
    nth = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id"))
    sample = classes.join(stats, "dim").where(place < F.lit(4.0 * SAMPLE_VECTORS) / F.col("n")).withColumn("nth", nth).where(
        F.col("nth") <= SAMPLE_VECTORS).select("dim", "scale", "n", "nth", "v")

    def measured(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("nth")
        scale, n = float(own["scale"].iloc[0]), int(own["n"].iloc[0])
        x = np.array(own["v"].tolist()) / scale
        q = x[:SAMPLE_QUERIES] / np.sqrt((x[:SAMPLE_QUERIES] ** 2).sum(axis=1, keepdims=True))
        near = -np.sort(-(q @ x.T), axis=1)
        rank = min(len(x) - 1, max(1, round(k * len(x) / n)))
        radius = float(np.sqrt(np.maximum(0.05, 2 - 2 * np.quantile(near[:, rank], 0.25))))
        return pd.DataFrame({"dim": own["dim"].iloc[:1], "scale": scale, "radius": radius})

    return cut_lineage(sample.groupBy("dim").applyInPandas(measured, "dim int, scale double, radius double"))


def search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, tables: int = 4,
           hashes: int = 4, width: float = 1.6, success: float = 0.62, part_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every row for which ``is_query`` (a condition on ``id``) holds."""
    own = cut_lineage(vectors(rows, id_col, vector_col).select("id", "v", "dim", *two_hashes(F.col("v"))))
    by_class = Window.partitionBy("_h1", "_h2").orderBy("id")
    members = own.select("id", "_h1", "_h2").withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k + 1)
    classes = cut_lineage(own.groupBy("_h1", "_h2").agg(F.min("id").alias("id"), F.min("v").alias("v"), F.min("dim").alias("dim")))
    asked = own.where(is_query).select("_h1", "_h2").distinct()
    queries = cut_lineage(classes.join(asked, ["_h1", "_h2"], "left_semi").select("id", "v", "dim"))
    lengths = fit(classes, k)

    def make(dim: int, scale: float, radius: float) -> Hashing:
        return Hashing(dim, scale, radius, tables, hashes, width * radius, success)

    key = "dim int, table int, cell int, id bigint, v array<double>"
    measured = ["dim", "scale", "radius", "id", "v"]
    index = classes.join(lengths, "dim").select(*measured).mapInPandas(lambda it: hash_rows(it, make), f"{key}, bucket bigint")
    index = cut_lineage(index)
    # written, so its size is known: Spark broadcasts it if it is small, and queries are not dealt by the few first cells
    salts = cut_lineage(index.groupBy("dim", "table", "cell").agg(
        F.ceil(F.count(F.lit(1)) * 8 * F.col("dim") / part_bytes).cast("int").alias("salts")))
    salted = index.join(salts, ["dim", "table", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))

    def ask(probes: DataFrame, index_rows: DataFrame) -> DataFrame:
        """Best k of each part for the queries that visit it."""
        sent = probes.join(salts, ["dim", "table", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        columns = ["dim", "table", "cell", "salt", "asks", "id", "v", "bucket", "visits"]
        both = index_rows.withColumn("asks", F.lit(0)).withColumn("visits", F.lit(None).cast("array<bigint>")).select(*columns).unionByName(
            sent.withColumn("asks", F.lit(1)).withColumn("bucket", F.lit(None).cast("bigint")).select(*columns))
        sort = ["dim", "table", "cell", "salt", "asks"]
        dealt = both.repartition(*sort[:4]).sortWithinPartitions(*sort)
        return dealt.mapInPandas(lambda it: meet(it, k + 1), "query bigint, id bigint, score double")

    probes = queries.join(lengths, "dim").select(*measured).mapInPandas(lambda it: probe_rows(it, make), f"{key}, visits array<bigint>")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")

    def nearest(found: DataFrame) -> DataFrame:
        merged = found.groupBy("query", "id").agg(F.max("score").alias("score"))
        return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).drop("rank")

    first = cut_lineage(nearest(ask(probes, salted)))
    # a query class that found too few classes visits everything: all buckets of table 0
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    counted = first.groupBy("query").agg(F.count(F.lit(1)).alias("found"))
    short = queries.join(sizes, "dim").join(counted, F.col("id") == F.col("query"), "left").where(
        F.coalesce("found", F.lit(0)) < F.least(F.col("n"), F.lit(k + 1))).select("dim", "id", "v")
    short = cut_lineage(short)
    found = first
    if short.limit(1).count():
        cells = salts.where("table = 0").select("dim", "table", "cell")
        everywhere = short.join(cells, "dim").select(
            "dim", "table", "cell", "id", "v", F.lit(None).cast("array<bigint>").alias("visits"))
        whole = nearest(ask(everywhere, salted.where("table = 0")))
        found = first.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(whole)

    # classes to ids: at most k + 1 members of a class can be among a query's k nearest besides itself
    names = classes.select("_h1", "_h2", F.col("id").alias("class"))
    ids = members.join(names, ["_h1", "_h2"]).select("class", F.col("id").alias("member"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "member")
    listed = found.join(ids, F.col("id") == F.col("class")).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k + 1).select("query", "member", "score")
    asking = own.where(is_query).join(names, ["_h1", "_h2"]).select(F.col("id").alias("query_id"), "class")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "member")
    out = asking.join(listed, F.col("class") == F.col("query")).where(F.col("member") != F.col("query_id"))
    return out.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("member").alias(id_col), "score")


ship(__name__)

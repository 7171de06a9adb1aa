"""Centroid clustering on integer vectors with subvector dictionaries.

Vectors are turned into integers and packed once in *parts* of a few thousand. In a part every block of ``block`` dimensions has a
dictionary of its distinct subvectors, and a vector is a code a block: nothing is lost. A round computes the exact
squared distance of every dictionary entry to every centroid's subvector, once, and a vector's distance is the sum over blocks
of its codes' entries. The new centroid needs the entries' sums weighted by how often a cluster uses them. Parts are
written as a table, so that rounds reread codes only, and a lost executor's parts are read again; a round sends back at most
clusters x (dimensions + 2) numbers of each part, summed by Spark, and only the clusters' sums reach the driver.

Ties go to the lesser centroid number. Vectors that are null, of another length, or hold a null or non-finite component take no part.
Rows of one id are vectors of their own; equal hashes (of one id) start in the order of the components. With fewer vectors than
``clusters`` all of them start, and an empty table gives an empty result. A component of 2^27 or more in integers
ends the run, since its squared distance may not fit the result's 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm.common import ship
from hopline.session import cut_lineage

BLOCK = 2  # dimensions of a subvector
PART_ROWS = 8192  # vectors packed together
AT_ONCE = 2048  # of a part, whose distances are summed together
LARGEST = 1 << 27

PACKED = "ids array<bigint>, codes array<binary>, entries array<array<bigint>>"


def integer_vectors(rows: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that take part, each component floor(scale * x) in double precision."""
    v, x = F.col("v"), F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))))
    small = F.forall(v, lambda c: F.abs(c) < F.lit(float(LARGEST // scale)))
    kept = rows.select(F.col(id_col).alias("id"), x.alias("v")).where((F.size("v") == dims) & finite)
    return kept.select("id", F.when(small, whole).otherwise(F.raise_error(F.lit("a component is too large for 64-bit distances"))).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, salt: str) -> list[list[int]]:
    """The vectors of the least sha256 of ``salt`` and id, in that order."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256).alias("h"), "v")
    return [list(r["v"]) for r in hashed.orderBy("h", "v").limit(clusters).collect()]


def encode_part(vectors: np.ndarray, block: int) -> tuple[list[bytes], list[list[int]]]:
    """(codes, entries) of each block: 32-bit codes of all vectors, and the distinct subvectors one behind the other."""
    codes, entries = [], []
    for a in range(0, vectors.shape[1], block):
        own, code = np.unique(vectors[:, a:a + block], axis=0, return_inverse=True)
        codes.append(code.astype(np.int32).tobytes())
        entries.append(own.ravel().tolist())
    return codes, entries


def pack(vectors: DataFrame, dims: int, block: int) -> DataFrame:
    """The vectors as parts."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ids", pa.list_(pa.int64())), ("codes", pa.list_(pa.binary())), ("entries", pa.list_(pa.list_(pa.int64())))])

        def packed(ids: list, rows: np.ndarray) -> pa.RecordBatch:
            codes, entries = encode_part(rows, block)
            return pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip((ids, codes, entries), schema)], schema=schema)

        ids: list = []
        held: list[np.ndarray] = []
        for batch in batches:
            for a in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(a, PART_ROWS)
                ids += part.column(0).to_pylist()
                held.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims))
                if len(ids) >= PART_ROWS:
                    yield packed(ids, np.concatenate(held))
                    ids, held = [], []
        if ids:
            yield packed(ids, np.concatenate(held))

    return cut_lineage(vectors.select("id", "v").mapInArrow(fn, PACKED))


class Part:
    """One packed part and its distances to ``centroids``."""

    def __init__(self, codes: list[bytes], entries: list[list[int]], centroids: np.ndarray, block: int):
        self.codes = [np.frombuffer(c, np.int32) for c in codes]
        dims = centroids.shape[1]
        self.blocks = [slice(a, min(a + block, dims)) for a in range(0, dims, block)]
        self.entries = [np.array(e, np.int64).reshape(-1, b.stop - b.start) for e, b in zip(entries, self.blocks)]
        n, k = len(self.codes[0]), len(centroids)
        tables = []
        for own, b in zip(self.entries, self.blocks):  # exact distance of each distinct subvector, once
            table = np.zeros((len(own), k), np.int64)
            for d, c in zip(own.T, centroids[:, b].T):
                table += (d[:, None] - c) ** 2
            tables.append(table)
        self.cluster, self.distance = np.zeros(n, np.int32), np.zeros(n, np.int64)
        for a in range(0, n, AT_ONCE):
            total = np.zeros((min(AT_ONCE, n - a), k), np.int64)
            for table, code in zip(tables, self.codes):
                total += table[code[a:a + AT_ONCE]]
            self.cluster[a:a + AT_ONCE] = best = total.argmin(axis=1)  # the first of equals
            self.distance[a:a + AT_ONCE] = np.take_along_axis(total, best[:, None], 1)[:, 0]

    def sums(self, k: int) -> np.ndarray:
        """(k, dims): componentwise sums by cluster, from how often each cluster uses each dictionary entry."""
        out = []
        for own, code in zip(self.entries, self.codes):
            used = np.bincount(self.cluster.astype(np.int64) * len(own) + code, minlength=k * len(own)).reshape(k, len(own))
            out.append(used @ own)
        return np.concatenate(out, axis=1)


def assigned(parts: DataFrame, centroids: list[list[int]], block: int) -> dict[int, tuple[int, int, list[int]]]:
    """By cluster: vectors, their summed distance and their componentwise sums, all exact."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centroids, np.int64)
        k = len(at)
        for batch in batches:
            for codes, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = Part(codes, entries, at, block)
                size = np.bincount(part.cluster, minlength=k)
                spread = np.zeros(k, np.int64)
                np.add.at(spread, part.cluster, part.distance)
                numbers = np.column_stack((size, spread, part.sums(k)))
                used = np.flatnonzero(size)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(used, numbers.shape[1]).astype(np.int32)), pa.array(np.tile(np.arange(numbers.shape[1], dtype=np.int32), len(used))),
                    pa.array(numbers[used].ravel())], ["cluster", "pos", "n"])

    told = parts.select("codes", "entries").mapInArrow(fn, "cluster int, pos int, n bigint")
    sums = told.groupBy("cluster", "pos").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()  # clusters x (dims + 2) rows
    numbers: dict[int, dict[int, int]] = {}
    for r in sums:
        numbers.setdefault(r["cluster"], {})[r["pos"]] = int(r["n"])
    return {c: (n[0], n[1], [n[p] for p in range(2, len(n))]) for c, n in numbers.items()}


def fit(parts: DataFrame, centroids: list[list[int]], rounds: int, block: int) -> list[list[int]]:
    """Centroids after ``rounds``: exact floored means; empty ones stay."""
    for _ in range(rounds):
        found = assigned(parts, centroids, block)
        centroids = [[s // found[c][0] for s in found[c][2]] if c in found else old for c, old in enumerate(centroids)]
    return centroids


def cluster(rows: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", block: int = BLOCK,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector that takes part: its cluster and squared distance, the cluster's and the whole sum of distances, and the centroid's digest."""
    vectors = integer_vectors(rows, dims, scale, id_col, vector_col)
    out = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    start = first_centroids(vectors, clusters, salt)
    if not start:
        return rows.sparkSession.createDataFrame([], out)
    parts = pack(vectors, dims, block)
    centroids = fit(parts, start, rounds, block)
    spread = {c: found[1] for c, found in assigned(parts, centroids, block).items()}
    inertia = sum(spread.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centroids, np.int64)
        for batch in batches:
            for ids, codes, entries in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part = Part(codes, entries, at, block)
                own = part.cluster.tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(part.cluster), pa.array(part.distance), pa.array([spread[c] for c in own], pa.int64()),
                    pa.array([inertia] * len(own), pa.int64()), pa.array([digest[c] for c in own])],
                    ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    found = parts.mapInArrow(fn, "id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


ship(__name__)

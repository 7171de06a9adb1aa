"""Byte-level BPE encoding and decoding against the ranks of a public tokenizer.

A text is cut in pieces by the tokenizer's pattern and every piece is merged on its own.
Over a piece's byte positions lies a *segment tree* whose nodes store the leftmost position
of the least pair rank below them, so the root names the next merge and a merge makes
logarithmic point updates: the merged position, its left neighbour and the swallowed one.
The distinct pieces of a batch that fall in one size class are merged together, one row of
a numpy matrix each (row by row the same tree); a piece longer than ``WIDE`` bytes gets a tree of its own.
Pieces that a worker has merged before are looked up in a table of bounded size.

Null text counts as empty and gives no ids. The vocabulary file is read on the driver and broadcast; its size is
that of the file (about a megabyte). Texts are processed whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline.llm.common import ship

WIDE = 64  # bytes; longer pieces are merged alone
REMEMBERED = 250_000  # merged pieces in each half of a worker's memory
PART_CHARS = 1 << 21  # characters encoded at a time
NONE = np.int64(1 << 40)  # rank of a pair that is no token


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank`` that Spark or the driver can read."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks as arrays: ids of bytes, and the rank of every pair of tokens whose bytes make a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {
            (ranks[t[:i]] << 32) | ranks[t[i:]]: rank
            for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # open addressing: the slot of a pair by multiplicative hashing, with linear probing
        self.bits = int(len(pairs) * 4).bit_length()
        self.slots = np.full(1 << self.bits, -1, np.int64)
        at, todo = self._slot(self.keys), np.arange(len(self.keys))
        while len(todo):
            free = self.slots[at[todo]] < 0
            first = np.unique(at[todo[free]], return_index=True)[1]
            won = todo[free][first]
            self.slots[at[won]] = won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        out, at, todo = np.full(len(keys), NONE), self._slot(keys), np.arange(len(keys))
        while len(todo):
            entry = self.slots[at[todo]]
            found = entry >= 0
            same = found & (self.keys[entry] == keys[todo])
            out[todo[same]] = self.values[entry[same]]
            todo = todo[found & ~same]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out


def merge_together(pieces: list[bytes], size: int, vocab: Vocabulary) -> list[list[int]]:
    """Merge pieces of at most ``size`` bytes (a power of two), each on the segment tree in its row of ``tree``.

    Leaves hold rank * size + position, so that the least value is the leftmost pair of the least rank.
    Matrices are addressed flat: row r of the trees starts at r * 2 * size.
    """
    n, none = len(pieces), np.int32((1 << 30) // size * size)
    lens = np.fromiter(map(len, pieces), np.int64, n)
    inside = np.arange(size) < lens[:, None]
    raw = np.zeros((n, size), np.uint8)
    raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    ids = vocab.of_byte[raw].ravel()
    after = np.tile(np.arange(1, size + 1, dtype=np.int32), n)  # next live position; a piece's length or more: none
    before = np.tile(np.arange(-1, size - 1, dtype=np.int32), n)
    grid = np.full((n, 2 * size), none, np.int32)
    pair = np.flatnonzero(np.arange(1, size + 1) < lens[:, None])
    row, col = pair // size, pair & (size - 1)

    def values(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank = vocab.pair_rank(ids[left], ids[right])
        return np.where(rank < NONE, rank * size + at, none).astype(np.int32)

    grid[row, size + col] = values(pair, pair + 1, col)
    for level in range(size.bit_length() - 2, -1, -1):
        lo = 1 << level
        np.minimum(grid[:, 2 * lo:4 * lo:2], grid[:, 2 * lo + 1:4 * lo:2], out=grid[:, lo:2 * lo])
    tree = grid.ravel()

    def update(root: np.ndarray, at: np.ndarray, value) -> None:
        tree[root + size + at] = value
        node = at + size
        for _ in range(size.bit_length() - 1):
            node >>= 1
            child = root + 2 * node
            tree[root + node] = np.minimum(tree[child], tree[child + 1])

    live = np.flatnonzero(grid[:, 1] < none) if size > 1 else np.array([], np.int64)
    while len(live):
        root, base, end = live * (2 * size), live * size, lens[live]
        best = tree[root + 1].astype(np.int64)
        at = best & (size - 1)
        ids[base + at] = best // size
        gone = after[base + at].astype(np.int64)
        beyond = after[base + gone].astype(np.int64)
        after[base + at] = beyond
        after[base + gone] = -1
        more = np.flatnonzero(beyond < end)
        before[base[more] + beyond[more]] = at[more]
        value = np.full(len(live), none, np.int32)
        value[more] = values(base[more] + at[more], base[more] + beyond[more], at[more])
        update(root, gone, none)
        update(root, at, value)
        left = before[base + at].astype(np.int64)
        has = np.flatnonzero(left >= 0)
        if len(has):
            update(root[has], left[has], values(base[has] + left[has], base[has] + at[has], left[has]))
        live = live[tree[root + 1] < none]
    alive = (after.reshape(n, size) > 0) & inside
    flat, cuts = ids[alive.ravel()].tolist(), np.concatenate(([0], np.cumsum(alive.sum(axis=1)))).tolist()
    return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


def merge_alone(piece: bytes, vocab: Vocabulary) -> list[int]:
    """The same for one long piece, on lists."""
    n, ranks = len(piece), vocab.ranks
    size = 1 << (n - 1).bit_length()
    none = int(NONE) * size
    end = [i + 1 for i in range(n)]  # position i holds the token piece[i:end[i]] while it lives
    start_of_left = [i - 1 for i in range(n)]
    tree = [none] * (2 * size)

    def rank(i: int) -> int:
        j = end[i]
        if j >= n or (r := ranks.get(piece[i:end[j]])) is None:
            return none
        return r * size + i

    for i in range(n - 1):
        tree[size + i] = rank(i)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                break
            tree[node] = least

    while (best := tree[1]) < none:
        i = best & (size - 1)
        gone = end[i]
        end[i] = end[gone]
        if end[i] < n:
            start_of_left[end[i]] = i
        update(gone, none)
        update(i, rank(i))
        if (left := start_of_left[i]) >= 0:
            update(left, rank(left))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def merge_all(pieces: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Ids of each piece; pieces of one size class go together."""
    out: list[list[int]] = [[]] * len(pieces)
    classes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if (whole := vocab.ranks.get(piece)) is not None:
            out[i] = [whole]
        elif len(piece) > WIDE:
            out[i] = merge_alone(piece, vocab)
        elif piece:
            classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
    for size, members in classes.items():
        for a in range(0, len(members), 1 << 13):
            part = members[a:a + (1 << 13)]
            for i, ids in zip(part, merge_together([pieces[i] for i in part], size, vocab), strict=True):
                out[i] = ids
    return out


def narrow(pattern: str) -> re.Pattern:
    """The pattern for texts of code points under 256, its Unicode classes spelt out: the plain engine is twice as fast."""
    def spelt(cls: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(256) if regex.match(cls, chr(c)))

    letters, digits, space = spelt(r"\p{L}"), spelt(r"\p{N}"), spelt(r"\s")
    for cls, own in ((r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{digits}]"), (r"\p{L}", f"[{letters}]"),
                     (r"\p{N}", f"[{digits}]"), (r"\s", f"[{space}]"), (r"\S", f"[^{space}]")):
        pattern = pattern.replace(cls, own)
    return re.compile(pattern)


class Encoder:
    """Encodes batches of texts; ``memory`` keeps merged pieces and may outlive the task in its worker.

    A piece maps to its ids as little-endian 32-bit integers. The memory has a young and an old half of at most
    ``REMEMBERED`` pieces: a full young half becomes the old one, and what is met again is young again.
    """

    def __init__(self, vocab: Vocabulary, pattern: str, memory: dict | None = None):
        self.vocab, self.wide, self.narrow = vocab, regex.compile(pattern), narrow(pattern)
        self.memory = {} if memory is None else memory
        self.memory.setdefault("young", {}), self.memory.setdefault("old", {})

    def encode(self, texts: list[str]) -> Iterator[list[bytes]]:
        """Lists of each text's ids, packed, for a few megabytes of text at a time."""
        part: list[str] = []
        chars = 0
        for text in texts:
            part.append(text)
            chars += len(text)
            if chars >= PART_CHARS:
                yield list(self._encode(part))
                part, chars = [], 0
        yield list(self._encode(part))

    def _cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide.findall(text)
        return self.narrow.findall(text)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        cut = [self._cut(text) for text in texts]
        young, old = self.memory["young"], self.memory["old"]
        if len(young) > REMEMBERED:
            young, old = {}, young
            self.memory.update(young=young, old=old)
        new = []
        for piece in set().union(*cut).difference(young):
            if (ids := old.get(piece)) is None:
                new.append(piece)
            else:
                young[piece] = ids
        for piece, ids in zip(new, merge_all([p.encode("utf-8", "replace") for p in new], self.vocab), strict=True):
            young[piece] = pack(f"<{len(ids)}I", *ids)
        look = young.__getitem__
        for pieces in cut:
            yield b"".join(map(look, pieces))


class Decoder:
    def __init__(self, vocab: Vocabulary):
        self.tokens = [vocab.tokens.get(i, b"") for i in range(max(vocab.tokens) + 1)]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _tasks(spark: SparkSession, path: str):
    """A function for tasks that gives the vocabulary and the worker's memory, both kept beside the broadcast ranks."""
    shared = spark.sparkContext.broadcast({"ranks": read_ranks(spark, path)})

    def vocabulary() -> tuple[Vocabulary, dict]:
        held = shared.value
        if "vocabulary" not in held:
            held["vocabulary"], held["memory"] = Vocabulary(held["ranks"]), {}
        return held["vocabulary"], held["memory"]

    return vocabulary


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text in ``ids_col``, packed as little-endian unsigned 32-bit integers."""
    vocabulary = _tasks(docs.sparkSession, path)

    @F.pandas_udf("binary")
    def packed_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab, memory = vocabulary()
        encoder = Encoder(vocab, pattern, memory)
        for texts in batches:
            for ids in encoder.encode(texts.fillna("").tolist()):
                yield pd.Series(ids, dtype=object)

    return docs.withColumn(ids_col, packed_ids(F.col(text_col)))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that the packed ids stand for in ``bytes_col``; null ids give no bytes."""
    vocabulary = _tasks(encoded.sparkSession, path)

    @F.pandas_udf("binary")
    def text_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(vocabulary()[0])
        for packed in batches:
            yield pd.Series([decoder.decode(p or b"") for p in packed], dtype=object)

    return encoded.withColumn(bytes_col, text_bytes(F.col(ids_col)))


def encoded(docs: DataFrame, path: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, ``n_tokens`` and ``ids`` of every document. Ids that do not decode to the text's bytes end the run."""
    names = {c: f"_{i}" for i, c in enumerate(keep)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(text_col).alias("text"))
    same = F.col("c.decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    ids = F.when(same, F.col("c.ids")).otherwise(F.raise_error(F.lit("token ids do not decode to their text")))
    checked = round_trip(rows, path, pattern, "text", "c").withColumn("ids", ids)
    return checked.select(
        *[F.col(n).alias(c) for c, n in names.items()], (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "coded") -> DataFrame:
    """``docs`` with ``out_col``: (ids, decoded), encoded and decoded again in one Python worker a task."""
    vocabulary = _tasks(docs.sparkSession, path)

    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab, memory = vocabulary()
        encoder, decoder = Encoder(vocab, pattern, memory), Decoder(vocab)
        for texts in batches:
            for ids in encoder.encode(texts.fillna("").tolist()):
                yield pd.DataFrame({"ids": ids, "decoded": [decoder.decode(p) for p in ids]}, dtype=object)

    return docs.withColumn(out_col, both(F.col(text_col)))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of ids, digest of the ids and digest of the bytes that they decode to."""
    coded = round_trip(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path, pattern, "text", "c")
    return coded.select(
        F.col("id").alias(id_col),
        (F.octet_length("c.ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("c.ids", 256).alias("ids_sha256"),
        F.sha2("c.decoded", 256).alias("decoded_sha256"),
    )


ship(__name__)

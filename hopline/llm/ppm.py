"""Language identification by prediction by partial matching.

For every language a variable-order byte context tree: the contexts of up to ``order`` bytes, with the counts of the byte that
followed. A byte that its longest context has seen costs -log2(count / (n + q)), n counts and q distinct bytes; otherwise
the escape costs -log2(q / (n + q)) and the context one byte shorter decides among the bytes not seen so far (those seen
are excluded); below order 0 all 256 bytes are alike. Training freezes the counts, so the cost of a byte depends
on its context alone: the trees become a sparse table of exact costs, a row of languages for each context and byte that some
language has seen and a row of escape costs for each context. A text's code length in each language is a sum of looked-up
costs. The shortest code wins; the score is its share among 2 ** -length, lengths as they are, so it is near 1 for
all but short texts; ``bits_per_byte``, the shortest length by the text's bytes, tells how well a text fits its language.

The trees are fitted on a bounded sample: about ``docs_per_language`` documents of each language, the chosen ones by a hash of
their id, whole texts of them. Contexts met fewer than ``least`` times in all languages together are left to their suffixes;
``least`` is doubled until the model takes at most ``model_bytes``, so what is broadcast does not grow with the languages.
Every text is scored whole, in pieces of bounded size. Null texts and texts without a letter get ``und``, score 0 and no bits.
If nothing can be learned from (no rows with text and language), all are ``und``. Ties go to the lesser language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.llm.common import ship

ORDER = 3
PIECE = 1 << 20  # bytes scored at a time
UNKNOWN = "und"


def held_out(id_col: str, parts: int, which: int) -> Column:
    """Whether a row is kept out of learning: crc32 of the id as text, modulo ``parts``, is ``which``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == which, F.lit(False))


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of order + 1 bytes, as integers, and their counts; a text starts after ``order`` zero bytes."""
    codes, counts = np.array([], np.int64), np.array([], np.int64)
    pending, held = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate([*pending, np.array([], np.int64)]), return_counts=True)
        every, where = np.unique(np.concatenate([codes, new]), return_inverse=True)
        return every, np.bincount(where, np.concatenate([counts, n]), len(every)).astype(np.int64)

    for text in texts:
        raw = text.encode("utf-8", "replace")
        for a in range(0, len(raw), PIECE):
            pending.append(windows(raw[a:a + PIECE], order, raw[max(0, a - order):a]))
            held += len(pending[-1])
            if held >= PIECE:
                codes, counts = merged()
                pending, held = [], 0
    return merged()


def windows(raw: bytes, order: int, before: bytes = b"") -> np.ndarray:
    """For each byte, the ``order`` bytes before it and itself as one integer; ``before`` are the bytes before the first."""
    padded = np.frombuffer(before.rjust(order, b"\0") + raw, np.uint8).astype(np.int64)
    code = np.zeros(len(raw), np.int64)
    for i in range(order + 1):
        code = (code << 8) | padded[i:i + len(raw)]
    return code


class Model:
    """Costs by context: ``keys`` (context row * 256 + byte, sorted) have a row of ``cost`` each, context rows one of ``escape``
    and the row of their suffix, ``parent``; a byte without a key costs the escape and what it costs in the suffix."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER, least: int = 8):
        """``counts``: for each language the windows of order + 1 bytes and how often each came."""
        if not 0 <= order <= 3:
            raise ValueError("contexts have at most 3 bytes")
        self.languages, self.order = languages, order
        n_lang = len(languages)
        # row 0: below order 0, all bytes alike
        self.keys, self.parent = np.arange(256), np.zeros(1, np.int64)
        chance, escape = np.full((256, n_lang), 1 / 256), np.ones((1, n_lang))
        contexts, rows = np.zeros(1, np.int64), np.zeros(1, np.int64)  # of the level below: sorted integers and their rows
        for k in range(order + 1):
            # counts of (context of k bytes, byte) for each language
            mask = (1 << (8 * (k + 1))) - 1
            tables = []
            for codes, n in counts:
                pairs, where = np.unique(codes & mask, return_inverse=True)
                tables.append((pairs, np.bincount(where, n, len(pairs))))
            every = np.unique(np.concatenate([pairs for pairs, _ in tables]))
            count = np.zeros((len(every), n_lang))
            for i, (pairs, n) in enumerate(tables):
                count[np.searchsorted(every, pairs), i] = n
            known, own = np.unique(every >> 8, return_inverse=True)
            good = np.ones(len(known), bool)
            if k:
                good = np.bincount(own, count.sum(axis=1), len(known)) >= least
            suffix = self._rows_of(known & ((1 << (8 * (k - 1))) - 1) if k else np.zeros(len(known), np.int64), contexts, rows)
            good &= suffix >= 0
            kept = good[own]
            every, count, known, suffix = every[kept], count[kept], known[good], suffix[good]
            own = np.searchsorted(known, every >> 8)
            below = self._chances(suffix[own], every & 255, chance, escape)
            starts = np.searchsorted(own, np.arange(len(known)))

            def sums(values: np.ndarray) -> np.ndarray:
                return np.add.reduceat(values, starts, axis=0) if len(starts) else np.zeros((0, n_lang))

            total, distinct, covered = sums(count), sums((count > 0).astype(float)), sums(np.where(count > 0, below, 0))
            full = distinct == 256  # nothing to escape to
            share = np.where(full, 1, np.maximum(1 - covered, 1e-12))  # what the suffix gives to bytes not seen
            room = np.maximum(total + np.where(full, 0, distinct), 1)
            out = np.where(total > 0, distinct / room / share, 1)  # a language that never saw the context goes by its suffix
            chance = np.concatenate([chance, np.where(count > 0, count / room[own], out[own] * below)])
            contexts, rows = known, len(self.parent) + np.arange(len(known))
            self.keys = np.concatenate([self.keys, rows[own] * 256 + (every & 255)])
            self.parent, escape = np.concatenate([self.parent, suffix]), np.concatenate([escape, out])
            setattr(self, f"contexts_{k}", contexts), setattr(self, f"rows_{k}", rows)
        self.cost, self.escape = -np.log2(chance).astype(np.float32), -np.log2(escape).astype(np.float32)

    def _chances(self, rows: np.ndarray, after: np.ndarray, chance: np.ndarray, escape: np.ndarray) -> np.ndarray:
        """The chance of each byte ``after`` the context of its row, in each language."""
        out, todo = np.ones((len(rows), chance.shape[1])), np.arange(len(rows))
        while len(todo):
            key = rows * 256 + after[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[todo[hit]] *= chance[at[hit]]
            todo, rows = todo[~hit], rows[~hit]
            out[todo] *= escape[rows]
            rows = self.parent[rows]
        return out

    def nbytes(self) -> int:
        """Memory of the model in a task: its arrays and the direct table that ``prepare`` makes of the keys."""
        return sum(x.nbytes for x in self.__dict__.values() if isinstance(x, np.ndarray)) + 1024 * len(self.parent)

    @staticmethod
    def _rows_of(codes: np.ndarray, contexts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The row of each code among sorted contexts, or -1."""
        if not len(contexts):
            return np.full(len(codes), -1, np.int64)
        at = np.minimum(np.searchsorted(contexts, codes), len(contexts) - 1)
        return np.where(contexts[at] == codes, rows[at], -1)

    def prepare(self) -> None:
        """Direct tables: the longest known context that ends in two given bytes, or in a two-byte context and one more;
        and the cost row of a context row and byte, or -1."""
        self.slot = np.full(len(self.parent) * 256, -1, np.int32)
        self.slot[self.keys] = np.arange(len(self.keys), dtype=np.int32)
        first = np.full(1 << 16, 0 if not len(self.rows_0) else self.rows_0[0], np.int32)
        for k in (1, 2)[:self.order]:
            codes, rows = getattr(self, f"contexts_{k}"), getattr(self, f"rows_{k}")
            if k == 1:
                by_byte = first[:256].copy()
                by_byte[codes] = rows
                first = np.tile(by_byte, 256)
            else:
                first[codes] = rows
        self.two = first
        # order 3: a row of 256 for every two-byte ending that some three-byte context has
        self.third_slot = np.zeros(1 << 16, np.int32)
        codes, rows = (getattr(self, "contexts_3"), getattr(self, "rows_3")) if self.order >= 3 else (np.array([], np.int64),) * 2
        ends = np.unique(codes & 0xFFFF)
        self.third_slot[ends] = np.arange(1, len(ends) + 1)
        self.third = np.full((len(ends) + 1) * 256, -1, np.int32)
        self.third[self.third_slot[codes & 0xFFFF] * 256 + (codes >> 16)] = rows

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        size = max(1, min(PIECE, 8 * PIECE // len(self.languages)))  # a byte takes a cost for each language
        raws, owners, held = [], [], 0
        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "replace")
            for a in range(0, len(raw), size):
                raws.append(raw[max(0, a - self.order):a].rjust(self.order, b"\0") + raw[a:a + size])
                owners.append(i)
                held += len(raws[-1])
                if held >= size:
                    self._add(out, raws, owners)
                    raws, owners, held = [], [], 0
        self._add(out, raws, owners)
        return out

    def _add(self, out: np.ndarray, raws: list[bytes], owners: list[int]) -> None:
        """Adds the costs of pieces; each starts with ``order`` bytes of context that cost nothing."""
        if not raws:
            return
        flat = np.frombuffer(b"".join(raws), np.uint8).astype(np.int32)
        two = np.zeros(len(flat), np.int32)
        two[1:] = flat[:-1]
        two[2:] |= flat[:-2] << 8
        row = self.two[two]
        if self.order >= 3:
            before = np.zeros(len(flat), np.int32)
            before[3:] = flat[:-3]
            long = self.third[self.third_slot[two] * 256 + before]
            row = np.where(long >= 0, long, row)
        row = row.astype(np.int64)
        at = self.slot[row * 256 + flat]
        cost, todo = self.cost[np.maximum(at, 0)], np.flatnonzero(at < 0)
        cost[todo], row = 0, row[todo]
        while len(todo):  # a level shorter each time
            cost[todo] += self.escape[row]
            row = self.parent[row]
            at = self.slot[row * 256 + flat[todo]]
            hit = at >= 0
            cost[todo[hit]] += self.cost[at[hit]]
            todo, row = todo[~hit], row[~hit]
        lens = np.fromiter(map(len, raws), np.int64, len(raws))
        starts = np.cumsum(lens) - lens
        heads = (starts[:, None] + np.arange(self.order)).ravel()
        cost[heads] = 0
        np.add.at(out, owners, np.add.reduceat(cost, starts, axis=0, dtype=np.float64))


def sample_counts(learn: DataFrame, order: int, docs_per_language: int) -> tuple[list[str], list]:
    """Languages and their window counts over the sample, counted by Spark; rows (id, text, lang)."""
    # the languages are the model's columns, so a few; their shares go into the filter and texts are not shuffled
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], []
    share = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(docs_per_language / n))])
    chance = F.xxhash64("id", "text").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    chosen = learn.where(chance < share[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                codes, n = grams(own["text"].tolist(), order)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": n})

    counted = chosen.select("lang", "text").mapInPandas(count, "lang string, code bigint, n bigint")
    rows = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    return languages, [
        tuple(own[c].to_numpy(np.int64) for c in ("code", "n")) for own in (rows[rows["lang"] == x] for x in languages)]


def fit(learn: DataFrame, order: int = ORDER, docs_per_language: int = 800, least: int = 8,
        model_bytes: int = 128 << 20) -> Model | None:
    """The trees of all languages from rows (id, text, lang) without nulls in text and lang, in at most ``model_bytes``."""
    languages, counts = sample_counts(learn, order, docs_per_language)
    if not languages:
        return None
    model = Model(languages, counts, order, least)
    while model.nbytes() > model_bytes and len(model.parent) > 2:  # row 0 and the empty context always stay
        least *= 2
        model = Model(languages, counts, order, least)
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score`` and ``bits_per_byte`` of every document."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.when(F.rlike(text, F.lit(r"\p{L}")), text).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("bits_per_byte"))
    shared = docs.sparkSession.sparkContext.broadcast({"state": model.__dict__})  # ``fit`` bounds its size

    @F.pandas_udf("lang string, score double, bits double")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees = Model.__new__(Model)
        trees.__dict__ = shared.value["state"]
        if not hasattr(trees, "two"):
            trees.prepare()
        names = np.array(trees.languages, object)
        for texts in batches:
            some = texts.notna().to_numpy()
            lengths = trees.lengths(texts.fillna("").tolist())
            best, least = lengths.argmin(axis=1), lengths.min(axis=1)
            share = 1 / np.exp2(least[:, None] - lengths).sum(axis=1)
            size = texts.fillna(" ").map(lambda t: len(t.encode("utf-8", "replace"))).to_numpy()
            lang = pd.Series(np.where(some, names[best], UNKNOWN), dtype=object)
            bits = pd.Series(least / np.maximum(size, 1)).astype(object).where(some, None)
            yield pd.DataFrame({"lang": lang, "score": np.where(some, share, 0.0), "bits": bits})

    return rows.withColumn("found", decide("text")).select(
        F.col("id").alias(id_col), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
        F.col("found.bits").alias("bits_per_byte"))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4,
            which: int = 2, **options) -> DataFrame:
    """Learns from the rows that are not held out, then identifies all: id, held_out, lang_pred, score, bits_per_byte."""
    learn = docs.where(~held_out(id_col, parts, which)).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).na.drop(subset=["text", "lang"])
    found = identify(docs, fit(learn, **options), id_col, text_col)
    return found.select(id_col, held_out(id_col, parts, which).alias("held_out"), "lang_pred", "score", "bits_per_byte")


ship(__name__)

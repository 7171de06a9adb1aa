"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

*Letters.* A text becomes a string over 32 symbols: space, a-z (case folded) and five classes of other letters. Other
characters are dropped, and so is a space between two single letters, so ``i.d-i o t`` reads ``idiot``.

*Kernel.* The features of a window of ``STARTS`` places are the subsequences of 4 symbols that begin there, neighbours at
most ``STEP`` apart, each occurrence weighing ``DECAY`` for every symbol skipped (inserted characters cost a little and break
nothing) and more the rarer the subsequence is in the training sentences. K(x, z) is the inner product of features, landmarks normalised.

*Machine.* Landmarks are windows of the training sentences; K(x, landmarks) times the inverse root of the landmarks' kernel
matrix gives Nystroem features, on which a squared-hinge SVM is trained. Only documents are labelled, so the windows of a toxic
document that look worst are its witnesses and the worst of the clean ones the counterexamples, and a few rounds renew both.
The decision function is linear in the kernel features, so it folds to one weight a subsequence and every window of
every text is scored exactly, whatever the number of landmarks. A document's score is a logistic function of its worst window.

Fitted on a bounded sample of labelled rows: at most ``docs_per_class`` documents of each label, ``pieces_per_doc`` sentences of
each (chosen by hash), ``PIECE`` characters a sentence. Labels, language, source and id are no inputs of a score.
Null texts count as empty. Texts with no letters score as a window without features. With no labelled rows of one class
nothing can be learned and every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from hopline.llm.common import ship
from hopline.llm.ppm import held_out

LETTERS = 5  # classes of the letters beyond a-z
SYMBOLS = 27 + LETTERS  # space, a-z, those
ORDER = 4
STEP = 3  # the next symbol is at most so many places on
DECAY = 0.9
STARTS = 10
PIECE = 400
CHUNK = 1 << 15
TAIL = STEP * (ORDER - 1)
OFFSETS = [np.cumsum(steps) for steps in product(range(1, STEP + 1), repeat=ORDER - 1)]
WEIGHTS = [DECAY ** (int(o[-1]) - ORDER + 1) for o in OFFSETS]
DROP = 255


def symbol_table() -> np.ndarray:
    """The symbol of every code point of the basic plane; one more entry for all others."""
    table = np.full(0x10000 + 1, DROP, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isspace():
            table[c] = 0
        elif ch.isalpha():
            low = ch.lower()[:1]
            table[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % LETTERS
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = table[np.minimum(points, 0x10000)]
    out = out[out != DROP]
    space = np.concatenate(([True], out == 0, [True]))  # place i of out is i + 1 here
    out = out[~(space[1:-1] & np.concatenate((space[:1], space[:-3], space[-1:]))[:len(out)]
                & np.concatenate((space[3:], [True, True]))[:len(out)])] if len(out) > 2 else out
    return out


def codes_at(line: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Feature numbers (start, subsequence) of the subsequences that begin at the starts; the line goes on ``TAIL`` beyond."""
    line = line.astype(np.int64)
    codes = []
    for offsets in OFFSETS:
        code = line[starts]
        for o in offsets:
            code = code * SYMBOLS + line[starts + o]
        codes.append(code)
    return np.stack(codes, axis=-1)


def window_codes(line: np.ndarray, firsts: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of whole windows."""
    starts = firsts[:, None] + np.arange(STARTS)
    codes = codes_at(line, starts.ravel()).reshape(len(firsts), -1)
    return codes, np.tile(np.array(WEIGHTS), STARTS) * rarity[codes]


def rarities(line: np.ndarray) -> np.ndarray:
    """Weight of every subsequence in the kernel: 1 for one never met, near 0 for the commonest."""
    counts = np.zeros(SYMBOLS ** ORDER)
    for a in range(0, len(line) - TAIL, CHUNK):
        codes = codes_at(line[a:a + CHUNK + TAIL], np.arange(min(CHUNK, len(line) - TAIL - a)))
        counts += np.bincount(codes.ravel(), minlength=len(counts))
    total = counts.sum() + 2
    return (np.log(total / (counts + 1)) / np.log(total)) ** 2


def place_scores(line: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each place but the last ``TAIL``, the weights of the subsequences that begin there."""
    n = len(line) - TAIL
    out = np.zeros(max(n, 0), np.float32)
    for a in range(0, n, CHUNK):
        part = line[a:a + min(CHUNK, n - a) + TAIL].astype(np.int64)
        m = len(part) - TAIL
        shifted = [part[o:o + m] for o in range(TAIL + 1)]
        total = np.zeros(m, np.float32)

        def go(code: np.ndarray, at: int, left: int) -> None:
            for step in range(1, STEP + 1):
                longer = code * SYMBOLS + shifted[at + step]
                if left == 1:
                    np.add(total, weight.take(longer) * np.float32(DECAY ** (at + step - ORDER + 1)), out=total)
                else:
                    go(longer, at + step, left - 1)

        go(shifted[0], 0, ORDER - 1)
        out[a:a + m] = total
    return out


def join_lines(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings with spaces between and around; the first place of each (a space before it) and the one beyond its last.

    A window that begins in between sees one string only.
    """
    gap = np.zeros(TAIL + STARTS, np.uint8)
    lens = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(lens + len(gap)) - lens - len(gap)
    line = np.concatenate([x for p in parts for x in (gap[:1], p, gap[1:])] + [gap])
    return line, starts, starts + 1 + lens


def highest(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The highest of each string's windows."""
    return np.maximum.reduceat(scores, np.stack([starts, ends], axis=1).ravel())[::2]


def window_scores(line: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The score of the window that begins at each place; the last ones are cut off."""
    return window_sums(place_scores(line, weight))


def window_sums(places: np.ndarray) -> np.ndarray:
    n = len(places) - STARTS + 1
    out = places[:n].copy()
    for k in range(1, STARTS):
        out += places[k:k + n]
    return out


# ------------------------------------------------------------- training


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of the linear SVM (the last one is the bias) by Newton steps on the active rows."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        active = y * (x @ w) < 1
        a, c = x[active], cost[active]
        new = np.linalg.solve(np.diag(penalty) + (a * c[:, None]).T @ a, a.T @ (c * y[active]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def fold(line: np.ndarray, bad: np.ndarray, good: np.ndarray, rank: np.ndarray, rarity: np.ndarray, landmarks: int) -> np.ndarray:
    """Train on windows (their first places) and fold the machine to one weight for each subsequence, the bias last."""
    some = [bad[np.argsort(-rank[bad], kind="stable")], good[np.argsort(-rank[good], kind="stable")]]
    share = [landmarks - landmarks // 4, landmarks // 4]
    chosen = np.concatenate([x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)] for x, n in zip(some, share)])
    codes, values = window_codes(line, np.concatenate([chosen, bad, good]), rarity)
    kernel = np.zeros((len(codes), len(chosen)))
    norms = np.zeros(len(chosen))
    features = np.zeros(SYMBOLS ** ORDER)
    for j in range(len(chosen)):
        np.add.at(features, codes[j], values[j])
        norms[j] = np.sqrt((features[np.unique(codes[j])] ** 2).sum()) or 1.0
        kernel[:, j] = np.einsum("ij,ij->i", features[codes], values) / norms[j]
        features[codes[j]] = 0
    among = kernel[:len(chosen)] / norms[:, None]
    found, vectors = np.linalg.eigh((among + among.T) / 2)
    keep = found > 1e-6 * found.max()
    root = vectors[:, keep] / np.sqrt(found[keep])  # Nystroem features = K(x, landmarks) @ root
    x = kernel[len(chosen):] @ root
    y = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
    cost = np.where(y > 0, 1.0 / max(1, len(bad)), 1.0 / max(1, len(good))) * len(y) / 2
    w = squared_hinge(x, y, cost)
    beta = root @ w[:-1] / norms
    weight = np.zeros(SYMBOLS ** ORDER + 1)
    for j, b in enumerate(beta):
        np.add.at(weight, codes[j], b * values[j])
    weight[:-1] *= rarity
    weight[-1] = w[-1]
    return weight


def worst(scores: np.ndarray, bounds: np.ndarray, of: np.ndarray, each: int) -> np.ndarray:
    """Places of the ``each`` highest windows of every document in ``of``, further apart than a window.

    ``bounds`` holds the documents' first places (their strings stand together) and one more.
    """
    out = []
    for d in of:
        own = scores[bounds[d]:bounds[d + 1]]
        some = np.argpartition(-own, min(len(own) - 1, 4 * STARTS * each))[:4 * STARTS * each]
        taken: list[int] = []
        for p in some[np.lexsort((some, -own[some]))]:
            if len(taken) == each or not np.isfinite(own[p]):
                break
            if all(abs(p - q) >= STARTS for q in taken):
                taken.append(int(p))
        out += [bounds[d] + p for p in taken]
    return np.array(out, np.int64)


class Machine:
    """The folded weights, and slope and offset from the worst window to the score."""

    def __init__(self, weight: np.ndarray, slope: float, offset: float):
        self.weight, self.slope, self.offset = weight.astype(np.float32), slope, offset

    def scores(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        out = np.full(len(texts), 0.0)
        parts, rows, held = [], [], 0

        def flush() -> None:
            if rows:
                line, starts, ends = join_lines(parts)
                out[rows] = highest(window_scores(line, self.weight), starts, ends)

        for i, text in enumerate(texts):
            parts.append(symbols(text, table))
            rows.append(i)
            held += len(parts[-1])
            if held >= 1 << 20:
                flush()
                parts, rows, held = [], [], 0
        flush()
        return 1 / (1 + np.exp(np.clip(-(self.slope * out + self.offset), -60, 60)))


def train(pieces: pd.DataFrame, rounds: int = 3, landmarks: int = 400) -> Machine | None:
    """From sentences (doc, toxic, text)."""
    if pieces["toxic"].nunique() < 2:
        return None
    pieces = pieces.sort_values(["doc", "text"], kind="stable")
    table = symbol_table()
    parts = [symbols(t, table) for t in pieces["text"]]
    line, starts, ends = join_lines(parts)
    doc_names, doc_of = np.unique(pieces["doc"].to_numpy(), return_inverse=True)
    toxic = np.zeros(len(doc_names), bool)
    toxic[doc_of] = pieces["toxic"].to_numpy() > 0
    places = len(line) - TAIL - STARTS + 1
    doc = np.full(places, -1, np.int32)  # the document whose window begins at a place
    for d, a, e in zip(doc_of, starts, ends, strict=True):
        doc[a:e] = d
    inside = doc >= 0
    bounds = np.append(starts[np.searchsorted(doc_of, np.arange(len(doc_names)))], places)
    bad_docs, good_docs = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    # first ranking: how much oftener toxic documents hold the four symbols from here
    plain = np.zeros(len(line) - TAIL, np.int32)
    for i in range(ORDER):
        plain = plain * SYMBOLS + line[i:i + len(plain)]
    pair = np.unique(doc[inside].astype(np.int64) * SYMBOLS ** ORDER + plain[:places][inside])
    where, own = pair % SYMBOLS ** ORDER, toxic[pair // SYMBOLS ** ORDER]
    hits, misses = (np.bincount(where[m], minlength=SYMBOLS ** ORDER) for m in (own, ~own))
    expected = (hits + misses) * len(bad_docs) / len(doc_names)
    surprise = np.maximum((hits - expected) / np.sqrt(expected + 1) - 1.5, 0)
    scores = window_sums(surprise.astype(np.float32)[plain])[:places]
    scores[~inside] = -np.inf
    del plain, pair, where, own
    clean_places = np.flatnonzero(inside & ~toxic[doc])
    random = np.random.default_rng(7).choice(clean_places, min(3000, len(clean_places)), replace=False)
    good = np.array([], np.int64)
    rarity = rarities(line)
    for _ in range(rounds):
        bad, clean = worst(scores, bounds, bad_docs, 3), worst(scores, bounds, good_docs, 2)
        # a witness looks worse than what clean documents hold; a document without one teaches nothing
        limit = np.quantile(scores[clean], 0.9)
        bad = bad[scores[bad] > limit] if (scores[bad] > limit).any() else bad
        good = np.unique(np.concatenate([good, clean]))
        weight = fold(line, bad, np.unique(np.concatenate([good, random])), scores, rarity, landmarks)
        scores = window_scores(line, weight[:-1].astype(np.float32))[:places]
        scores[~inside] = -np.inf
    top = np.full(len(doc_names), -np.inf)
    np.maximum.at(top, doc[inside], scores[inside])
    # the score is 0.7 midway between the clean documents' highest windows and the middle of the toxic documents'
    clean_top, toxic_middle = np.quantile(top[good_docs], 0.999), np.quantile(top[bad_docs], 0.4)
    low = np.quantile(top[bad_docs], 0.02)
    limit = max(clean_top + 0.25 * (toxic_middle - clean_top), min(low, 0.5 * (clean_top + toxic_middle)))
    if toxic_middle <= clean_top:  # the classes overlap: the limit that errs least
        cuts = np.unique(top)
        errors = [(top[good_docs] >= c).mean() + (top[bad_docs] < c).mean() for c in cuts]
        limit = cuts[int(np.argmin(errors))]
    slope = 6.0 / max(1e-6, abs(toxic_middle - clean_top))
    return Machine(weight[:-1], slope, np.log(0.7 / 0.3) - slope * limit)


def training_pieces(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, docs_per_class: int,
                    pieces_per_doc: int, parts: int, which: int) -> DataFrame:
    """Sentences (doc, toxic, text) of the sampled labelled documents that are not held out."""
    known = labels.select(F.col(id_col).alias("doc"), F.col("toxic")).na.drop().where(~held_out("doc", parts, which))
    known = known.groupBy("doc").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value in (0, 1):
        own = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc"), "doc").limit(docs_per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = texts.join(F.broadcast(chosen), F.col("id") == F.col("doc"))  # at most 2 * docs_per_class rows
    sentences = texts.select("doc", "toxic", F.explode(F.split("text", r"[.!?\n]+")).alias("sentence"))
    cut = sentences.select("doc", "toxic", F.explode(
        F.regexp_extract_all("sentence", F.lit("(?s).{1,%d}" % PIECE), F.lit(0))).alias("text")).distinct()
    nth = F.row_number().over(Window.partitionBy("doc").orderBy(F.xxhash64("text"), "text"))
    return cut.withColumn("nth", nth).where(F.col("nth") <= pieces_per_doc).drop("nth")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs_per_class: int = 600,
        pieces_per_doc: int = 40, parts: int = 3, which: int = 1) -> Machine | None:
    """Learns in one task, on the bounded sample; only the folded weights (one number a subsequence) come to the driver."""
    def learned(pieces: pd.DataFrame) -> pd.DataFrame:
        machine = train(pieces)
        return pd.DataFrame([] if machine is None else [(machine.weight.tobytes(), float(machine.slope), float(machine.offset))],
                            columns=["weight", "slope", "offset"])

    rows = training_pieces(docs, labels, id_col, text_col, docs_per_class, pieces_per_doc, parts, which)
    found = rows.withColumn("sample", F.lit(0)).groupBy("sample").applyInPandas(learned, "weight binary, slope double, offset double").first()
    return None if found is None else Machine(np.frombuffer(found["weight"], np.float32), found["slope"], found["offset"])


def score_udf(docs: DataFrame, machine: Machine):
    shared = docs.sparkSession.sparkContext.broadcast({"state": machine.__dict__, "table": symbol_table()})

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Machine.__new__(Machine)
        own.__dict__ = shared.value["state"]
        for texts in batches:
            yield pd.Series(own.scores(texts.fillna("").tolist(), shared.value["table"]))

    return toxicity


def scored(docs: DataFrame, machine: Machine | None, text_col: str = "text") -> Column:
    """The column of scores of ``docs``."""
    return F.lit(0.0) if machine is None else score_udf(docs, machine)(F.col(text_col))


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7,
            parts: int = 3, which: int = 1, **options) -> DataFrame:
    """Learns from labelled rows that are not held out (crc32 of the id mod ``parts`` is ``which``) and scores all documents: id, held_out,
    score, predicted. Ties of score do not matter: each document is judged by its own."""
    machine = fit(docs, labels, id_col, text_col, parts=parts, which=which, **options)
    rows = docs.select(F.col(id_col).alias("id"), scored(docs, machine, text_col).alias("score"))
    return rows.select(
        F.col("id").alias(id_col), held_out("id", parts, which).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7,
               **options) -> DataFrame:
    """The documents that score under the threshold, all columns as they are."""
    machine = fit(docs, labels, id_col, text_col, **options)
    return docs.where(scored(docs, machine, text_col) < threshold)


ship(__name__)

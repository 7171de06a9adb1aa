"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text gets the model's space mark before it and for every space, and is cut in words before each run of marks
(no piece of a model holds a mark behind another character; where one does, a text is one word). The distinct words
of a few megabytes lie one behind the other in flat numpy arrays of symbols. A *round* takes the least pair rank of
every word (equal scores have equal ranks), merges its occurrences from the left, all words at once, and compacts the
arrays; words without a pair leave. Rounds end when no word is left.

A queue that always merges the best pair, the leftmost of equals, gives the same: in each word a round stops behind the
first merge that makes a pair of the same or a lesser rank, for the queue would take that pair next. A long word whose rounds so
merge little (a run of thousands of spaces) is finished by such a queue. Words that a worker has merged before are
looked up in a table of bounded size.

Characters without a piece become byte pieces. Null text counts as empty and gives no ids. Decoding gives a space for each mark, drops the first one, and
gives U+FFFD for every byte that is no UTF-8. The model file is read on the driver and broadcast; its size is that of the file (half a megabyte here).
Texts are processed whole.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm.common import ship

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
PART_CHARS = 1 << 21  # characters encoded at a time
REMEMBERED = 250_000  # merged words in each half of a worker's memory
LONG_KEY = 64  # characters; longer words are not remembered
STALLED = 64  # symbols: a word of more, of which a round merges less than one in so many, goes to the queue
NONE = np.int64(1 << 40)  # rank of a pair that is no piece
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: kinds of pieces in a model file


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and the dummy prefix of a model file that the driver can open. Models that rewrite characters, lack byte pieces or
    have pieces of other kinds are refused."""
    from sentencepiece import sentencepiece_model_pb2 as files

    model = files.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rewritten = model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces
    kinds = {p.type for p in model.pieces}
    if (rewritten or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix
            or not model.normalizer_spec.escape_whitespaces or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}):
        raise ValueError("only models with byte pieces that leave characters as they are")
    return {
        "pieces": [(p.piece, p.score, p.type) for p in model.pieces], "prefix": model.normalizer_spec.add_dummy_prefix,
        "unknown": model.trainer_spec.unk_surface,
    }


class Vocabulary:
    """Ids of characters and bytes, and for every pair of symbols whose characters make a piece its rank and id.

    Symbols are the ids of pieces; a character that occurs in pieces without being one has a number behind them.
    """

    def __init__(self, model: dict):
        pieces = model["pieces"]
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.prefix, self.ids = model["prefix"], len(pieces)
        self.cut = not any(re.search(f"[^{MARK}]{MARK}", p) for p in normal)
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p}):
            symbols.setdefault(c, self.ids + len(symbols) - len(normal))
        self.of_char = np.full(0x110000, -1, np.int32)  # -1: in no piece
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.of_byte = np.zeros(256, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.of_byte[int(p[3:5], 16)] = i
        scores = sorted({pieces[i][1] for i in normal.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.width = self.ids + len(symbols)
        pairs = {
            symbols[p[:j]] * self.width + symbols[p[j:]]: (rank[pieces[i][1]], i)
            for p, i in normal.items() for j in range(1, len(p)) if p[:j] in symbols and p[j:] in symbols
        }
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NONE], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int64)
        self.pairs = pairs
        # what ids stand for: bytes, and whether the piece begins with a mark
        self.spelt = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL
            else model["unknown"].encode() if kind == UNKNOWN else p.replace(MARK, " ").encode()
            for p, _, kind in pieces
        ]
        self.silent = {i for i, s in enumerate(self.spelt) if not s}
        self.marked = [kind == NORMAL and p.startswith(MARK) for p, _, kind in pieces]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of each pair's piece; NONE and -1 where there is none."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        found = (self.keys[at] == key) & (left >= 0) & (right >= 0) if len(self.keys) else np.zeros(len(key), bool)
        at[~found] = -1
        return self.ranks[at], self.merged[at]


def merge_queue(symbols: list[int], vocab: Vocabulary) -> list[int]:
    """(places, symbols): what is left of one word's symbols, by a queue of pairs, and where each one begins."""
    n, width, pairs = len(symbols), vocab.width, vocab.pairs
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), symbols[:]
    queue = []

    def seen(i: int, j: int):
        if live[i] >= 0 and live[j] >= 0 and (pair := pairs.get(live[i] * width + live[j])) is not None:
            return pair[0], i, live[i], live[j], pair[1]

    for i in range(n - 1):
        if (entry := seen(i, i + 1)) is not None:
            queue.append(entry)
    heapify(queue)
    while queue:
        _, i, left, right, piece = heappop(queue)
        j = after[i]
        if j >= n or live[i] != left or live[j] != right:
            continue  # one of the two has been merged since
        live[i], live[j], after[i] = piece, -2, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (entry := seen(i, after[i])) is not None:
                heappush(queue, entry)
        if before[i] >= 0 and (entry := seen(before[i], i)) is not None:
            heappush(queue, entry)
    places, i = [], 0
    while i < n:
        places.append(i)
        i = after[i]
    return places, [live[i] for i in places]


def rounds(points: np.ndarray, lens: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that are left of words of ``lens`` code points ``points`` (no word is empty), and the place of each one's first code point."""
    sym = vocab.of_char[points].astype(np.int64)
    place = np.arange(len(sym))
    word = np.repeat(np.arange(len(lens)), lens)
    done_place, done_sym = [], []

    def looked_up(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs that begin at ``at``, all inside the arrays."""
        rank, piece = vocab.look_up(sym[at], sym[at + 1])
        rank[word[at] != word[at + 1]] = NONE
        return rank, piece

    rank, piece = np.full(len(sym), NONE), np.full(len(sym), -1, np.int64)
    if len(sym) > 1:
        rank[:-1], piece[:-1] = looked_up(np.arange(len(sym) - 1))
    while len(sym):
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        size = np.diff(np.append(starts, len(sym)))
        least = np.minimum.reduceat(rank, starts)
        over = np.repeat(least >= NONE, size)
        if over.any():
            done_place.append(place[over]), done_sym.append(sym[over])
            keep = ~over
            sym, place, word, rank, piece = (a[keep] for a in (sym, place, word, rank, piece))
            if not len(sym):
                break
            left_in, size = least < NONE, size[least < NONE]
            least, starts = least[left_in], np.concatenate(([0], np.cumsum(size)[:-1]))
        nth = np.repeat(np.arange(len(starts)), size)
        hit = rank == least[nth]
        # of pairs that overlap one another, every second one from the left
        at = np.flatnonzero(hit)
        run = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
        at = at[((at - np.repeat(at[run], np.diff(np.append(run, len(at))))) & 1) == 0]
        own, made = nth[at], piece[at]
        # pairs that a merge makes: with its left neighbour (perhaps merged itself in this round) and its right one
        prior = np.maximum(at - 1, 0)
        chained = np.concatenate(([False], at[1:] == at[:-1] + 2)) & np.concatenate(([False], own[1:] == own[:-1]))
        left = np.where(chained, np.concatenate(([0], made[:-1])), sym[prior])
        left[(at == 0) | (nth[prior] != own)] = -1
        following = np.minimum(at + 2, len(sym) - 1)
        right = np.where((at + 2 < len(sym)) & (nth[following] == own), sym[following], -1)
        again = np.minimum(vocab.look_up(left, made)[0], vocab.look_up(made, right)[0]) <= least[own]
        if again.any():  # nothing behind the first such merge of a word
            first = np.full(len(starts), len(sym))
            np.minimum.at(first, own[again], at[again])
            within = at <= first[own]
            at, own, made = at[within], own[within], made[within]
        merges = np.bincount(own, minlength=len(starts))
        sym[at] = made
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        changed = np.zeros(len(sym), bool)
        changed[at] = True
        changed[np.maximum(at - 1, 0)] = True
        slow = (size > STALLED) & (merges * STALLED < size)
        if slow.any():
            for w in np.flatnonzero(slow).tolist():
                own_places = np.arange(starts[w], starts[w] + size[w])
                own_places = own_places[stay[own_places]]
                kept, symbols = merge_queue(sym[own_places].tolist(), vocab)
                done_place.append(place[own_places[kept]]), done_sym.append(np.array(symbols, np.int64))
            stay &= ~slow[nth]
        sym, place, word, rank, piece, changed = (a[stay] for a in (sym, place, word, rank, piece, changed))
        fresh = np.flatnonzero(changed)
        if len(fresh) and fresh[-1] == len(sym) - 1:
            rank[-1], fresh = NONE, fresh[:-1]
        if len(fresh):
            rank[fresh], piece[fresh] = looked_up(fresh)
        if len(sym):
            rank[-1] = NONE
    place, sym = np.concatenate(done_place), np.concatenate(done_sym)
    order = np.argsort(place)
    return sym[order], place[order]


def merge_words(words: list[str], vocab: Vocabulary) -> list[bytes]:
    """The ids of each word, packed as 32-bit integers."""
    if not words:
        return []
    raw = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    sym, place = rounds(raw, lens, vocab)
    odd = np.flatnonzero((sym < 0) | (sym >= vocab.ids))
    if len(odd):  # characters without a piece: one id for each of their bytes
        spelt = [chr(c).encode("utf-8", "replace") for c in raw[place[odd]].tolist()]
        times = np.ones(len(sym), np.int64)
        times[odd] = list(map(len, spelt))
        sym[odd] = -1
        sym, place = np.repeat(sym, times), np.repeat(place, times)
        sym[sym < 0] = vocab.of_byte[np.frombuffer(b"".join(spelt), np.uint8)]
    ends = np.searchsorted(place, np.concatenate(([0], np.cumsum(lens)))) * 4
    packed, cuts = sym.astype(np.int32).tobytes(), ends.tolist()
    return [packed[a:b] for a, b in zip(cuts, cuts[1:])]


class Encoder:
    """Encodes batches of texts; ``memory`` keeps merged words (a young and an old half, each bounded) and may outlive a task in its worker."""

    def __init__(self, vocab: Vocabulary, memory: dict | None = None):
        self.vocab = vocab
        self.memory = {} if memory is None else memory
        self.memory.setdefault("young", {}), self.memory.setdefault("old", {})

    def encode(self, texts: list[str]) -> Iterator[list[array]]:
        """Lists of each text's ids for a few megabytes of text at a time."""
        part: list[str] = []
        chars = 0
        for text in texts:
            part.append(text)
            chars += len(text)
            if chars >= PART_CHARS:
                yield self._encode(part)
                part, chars = [], 0
        yield self._encode(part)

    def _encode(self, texts: list[str]) -> list[array]:
        mark = MARK if self.vocab.prefix else ""
        marked = [mark + t.replace(" ", MARK) if t else "" for t in texts]
        cut = [WORDS.findall(t) for t in marked] if self.vocab.cut else [[t] if t else [] for t in marked]
        young, old = self.memory["young"], self.memory["old"]
        if len(young) > REMEMBERED:
            young, old = {}, young
            self.memory.update(young=young, old=old)
        new, once = [], {}
        for word in set().union(*cut).difference(young):
            if (ids := old.get(word)) is None:
                new.append(word)
            else:
                young[word] = ids
        for word, ids in zip(new, merge_words(new, self.vocab), strict=True):
            (young if len(word) <= LONG_KEY else once)[word] = ids
        look = (lambda w: young[w] if w in young else once[w]) if once else young.__getitem__
        return [array("i", b"".join(map(look, words))) for words in cut]


def each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


class Decoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        codecs.register_error("hopline-each-byte", each_byte)

    def decode(self, ids) -> str:
        spelt, start = self.vocab.spelt, b""
        ids = list(ids)
        if self.vocab.prefix:  # the first piece that spells something loses its mark
            first = next((n for n, i in enumerate(ids) if spelt[i]), len(ids))
            if first < len(ids) and self.vocab.marked[ids[first]]:
                start, ids = spelt[ids[first]][1:], ids[first + 1:]
        if self.vocab.silent.isdisjoint(ids):
            return (start + b"".join(map(spelt.__getitem__, ids))).decode("utf-8", "hopline-each-byte")
        runs = [start]  # bytes on both sides of a silent piece do not make a character
        for i in ids:
            if i in self.vocab.silent:
                runs.append(b"")
            else:
                runs[-1] += spelt[i]
        return "".join(run.decode("utf-8", "hopline-each-byte") for run in runs)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "coded") -> DataFrame:
    """``docs`` with ``out_col``: (ids array<int>, decoded string), encoded and decoded again in one Python worker a task."""
    shared = docs.sparkSession.sparkContext.broadcast({"model": read_model(path)})

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = shared.value
        if "vocabulary" not in held:
            held["vocabulary"], held["memory"] = Vocabulary(held["model"]), {}
        encoder, decoder = Encoder(held["vocabulary"], held["memory"]), Decoder(held["vocabulary"])
        for texts in batches:
            for coded in encoder.encode([t or "" for t in texts.to_pylist()]):
                offsets = np.concatenate(([0], np.cumsum([len(ids) for ids in coded]))).astype(np.int32)
                flat = np.frombuffer(b"".join(ids.tobytes() for ids in coded), np.int32)
                yield pa.StructArray.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                     pa.array([decoder.decode(ids) for ids in coded], pa.string())], ["ids", "decoded"])

    return docs.withColumn(out_col, both(F.col(text_col)))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of ids, digest of the decimal ids joined by commas, digest of the text that they decode to."""
    coded = round_trip(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path, "text", "c")
    return coded.select(
        F.col("id").alias(id_col),
        F.size("c.ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("c.ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("c.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


ship(__name__)

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from hopline.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    """(text, lang, source) rows, by the definition: every kept term in every pair of groups."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = TERM.findall(lower)
        counts[lang, source].update(terms), docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, whole = len(kept), Counter()
        weights = {}
        for s in sources:
            n = sum(counts[lang, s][t] for t in kept)
            weights[s] = {t: 1 + D.SCALE * (counts[lang, s][t] + 1) // (n + v) for t in kept}
            whole.update({t: counts[lang, s][t] for t in kept})
        all_n = sum(whole.values())
        for s, p in weights.items():
            pairs = sorted((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o.encode(), o) for o, q in weights.items() if o != s)
            out += [(lang, s, "pair", o, -value, i + 1) for i, (value, _, o) in enumerate(pairs)]
            terms = []
            for t in kept:
                q = 1 + D.SCALE * (whole[t] + 1) // (all_n + v)
                if counts[lang, s][t] and p[t] > q:
                    terms.append((-((p[t] - q) ** 2 // q), t.encode(), t))
            out += [(lang, s, "term", t, -value, i + 1) for i, (value, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def told(frame, **options):
    return sorted(map(tuple, D.audit(frame, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_against_brute_force(spark, odd_docs, docs):
    rng = random.Random(1)
    words = ["alpha", "Beta", "ÉTÉ", "été", "x1y", "日本", "İ", "gamma-delta", "A\x00b"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(" ".join(rng.choice(words[:rng.randrange(1, len(words))]) for _ in range(rng.choice([0, 1, 5, 60]))),
             rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "b", "c", "d", "e", "ü", "Z", None])) for _ in range(300)]
    rows += [("only here", "xx", "a"), (None, "xx", "b"), ("", "yy", "a")]  # languages without kept terms
    made = spark.createDataFrame(rows, "text string, lang string, source string")
    for frame, options in ((made, {}), (made, {"least": 1, "top": 3}), (odd_docs, {}), (docs, {"top": 5})):
        assert told(frame, **options) == brute([(r["text"], r["lang"], r["source"]) for r in frame.collect()], **options)
    assert told(odd_docs.limit(0)) == []


def test_small_tables_give_the_same_counts(docs, monkeypatch):
    """Counts handed on early add up to the same."""
    rows = docs.select("lang", "source", "text").toArrow().to_batches(100)
    rows = [pa.RecordBatch.from_arrays([c.fill_null("") for c in b.columns], b.schema.names) for b in rows]

    def totals():
        sums = Counter()
        for batch in D.count_terms(iter(rows)):
            for lang, source, term, count, own in zip(*(c.to_pylist() for c in batch.columns)):
                sums[lang, source, term, "count"] += count
                sums[lang, source, term, "docs"] += own
        return sums

    many = totals()
    monkeypatch.setattr(D, "COUNTED", 50)
    assert totals() == many


def patterns(rng, n, sources):
    rows = Counter(tuple((s, rng.randrange(1, 4)) for s in range(sources) if rng.random() < .4) for _ in range(n))
    return sorted((r, m) for r, m in rows.items() if len(r) > 1)


def corrections(rows, p, p0):
    g = lambda a, b: a * a // b
    out = Counter()
    for row, times in rows:
        for a, ca in row:
            for b, cb in row:
                if a != b:
                    out[a, b] += times * (g(p[a, ca], p[b, cb]) - g(p[a, ca], p0[b]) - g(p0[a], p[b, cb]) + g(p0[a], p0[b]))
    return out


def test_tree_corrections(monkeypatch):
    rng = random.Random(4)
    rows = patterns(rng, 4000, 7)
    p = {(s, c): rng.randrange(1, 10 ** 9) for s in range(7) for c in range(1, 4)}
    p0 = {s: rng.randrange(1, 1000) for s in range(7)}
    flat = [(s, c, p[s, c], p0[s]) for r, _ in rows for s, c in r]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r, _ in rows])))
    tree = D.PatternTree(offsets, *(np.array(c, np.int64) for c in zip(*flat)), np.array([m for _, m in rows], np.int64))
    # one node for each distinct beginning, its multiplicity the rows that begin so
    starts = Counter()
    for r, m in rows:
        for d in range(len(r)):
            starts[r[:d + 1]] += m
    assert len(tree.item) == len(starts) and sorted(tree.times.tolist()) == sorted(starts.values())
    for size in (1 << 20, 7):
        monkeypatch.setattr(D, "COMBINATIONS", size)
        got = Counter()
        for group, item, high, low in tree.corrections():
            for a, b, h, w in zip(group.tolist(), item.tolist(), high.tolist(), low.tolist()):
                got[a, b] += h * 2 ** 31 + w
        assert got == corrections(rows, p, p0)


def test_trees_cut_anywhere(monkeypatch):
    rng = random.Random(5)
    rows = patterns(rng, 1500, 5)
    p = {(s, c): 10 ** 8 * (s + 1) + c for s in range(5) for c in range(1, 4)}
    p0 = {s: 17 + s for s in range(5)}
    kind = pa.list_(pa.struct([("code", pa.int32()), ("count", pa.int64()), ("p", pa.int64()), ("p0", pa.int64())]))
    listed = [[{"code": s, "count": c, "p": p[s, c], "p0": p0[s]} for s, c in r] for r, _ in rows]
    table = pa.table({"lang": ["en"] * len(rows) + ["fr"] * len(rows), "row": pa.array(listed * 2, kind), "times": [m for _, m in rows] * 2})
    want = corrections(rows, p, p0)
    for items in (1 << 21, 40):
        monkeypatch.setattr(D, "TREE_ITEMS", items)
        got = Counter()
        for batch in D.tree_corrections(iter(table.to_batches(33))):
            for lang, a, b, h, w in zip(*(c.to_pylist() for c in batch.columns)):
                got[lang, a, b] += h * 2 ** 31 + w
        assert got == Counter({(lang, a, b): v for lang in ("en", "fr") for (a, b), v in want.items()})

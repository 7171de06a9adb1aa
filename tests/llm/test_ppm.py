import random

import numpy as np
from pyspark.sql import functions as F

from hopline.llm import ppm

LANGS = {"aa": "the stone river and light of window", "bb": "der stein fluss und licht von fenster", "cc": "élève où ça très forêt"}


def sentences(rng, lang, n):
    words = LANGS[lang].split()
    return " ".join(rng.choice(words) for _ in range(n))


def distribution(counts, lang, context, order, least):
    """Blended with exclusion, from the definition: probabilities of the 256 bytes after a context."""
    tables = []
    for codes, n in counts:
        table = [{} for _ in range(order + 1)]
        for code, x in zip(codes.tolist(), n.tolist(), strict=True):
            for k in range(order + 1):
                key = (code & ((1 << 8 * (k + 1)) - 1)) >> 8
                table[k].setdefault(key, {}).setdefault(code & 255, 0)
                table[k][key][code & 255] += x
        tables.append(table)

    def known(k, c):
        return all(sum(sum(t[j].get(c & ((1 << 8 * j) - 1), {}).values()) for t in tables) >= (least if j else 1) for j in range(k + 1))

    def dist(k):
        if k < 0:
            return np.full(256, 1 / 256)
        below, c = dist(k - 1), context & ((1 << 8 * k) - 1)
        seen = tables[lang][k].get(c) if known(k, c) else None
        if not seen:
            return below
        n, q, out = sum(seen.values()), len(seen), np.zeros(256)
        out[list(seen)] = [x / (n + q) for x in seen.values()]
        fresh = np.ones(256, bool)
        fresh[list(seen)] = False
        out[fresh] = q / (n + q) * below[fresh] / below[fresh].sum()
        return out

    return dist(order)


def test_code_lengths_are_those_of_the_trees():
    rng = random.Random(1)
    counts = [ppm.grams([sentences(rng, lang, 30) for _ in range(5)], 3) for lang in LANGS]
    model = ppm.Model(list(LANGS), counts, least=3)
    model.prepare()
    for text in ("the stone", "forêt \U0001f600", "zzz", ""):
        raw = bytes(3) + text.encode()
        want = [sum(-np.log2(distribution(counts, i, int.from_bytes(raw[j - 3:j], "big"), 3, 3)[raw[j]]) for j in range(3, len(raw)))
                for i in range(3)]
        assert np.allclose(model.lengths([text])[0], want, rtol=1e-4)


def test_shorter_orders():
    rng = random.Random(4)
    texts = [[sentences(rng, lang, 30) for _ in range(5)] for lang in LANGS]
    for order in (0, 1, 2):
        counts = [ppm.grams(own, order) for own in texts]
        model = ppm.Model(list(LANGS), counts, order, least=3)
        model.prepare()
        raw = bytes(order) + "the forêt".encode()
        want = [sum(-np.log2(distribution(counts, i, int.from_bytes(raw[j - order:j], "big"), order, 3)[raw[j]])
                    for j in range(order, len(raw))) for i in range(3)]
        assert np.allclose(model.lengths(["the forêt"])[0], want, rtol=1e-4)


def test_chances_add_up_to_one_where_all_bytes_are_seen():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 256, 20_000).astype(np.uint8).tobytes()
    codes = np.unique(ppm.windows(text + bytes(range(256)) * 3, 3), return_counts=True)
    model = ppm.Model(["a", "b"], [codes, ppm.grams(["some text"], 3)], least=2)
    rows = np.repeat(np.arange(len(model.parent)), 256)
    chance = model._chances(rows, np.tile(np.arange(256), len(model.parent)), np.exp2(-model.cost.astype(float)),
                            np.exp2(-model.escape.astype(float))).reshape(-1, 256, 2)
    assert (chance > 0).all() and np.allclose(chance.sum(axis=1), 1, atol=1e-4)


def test_windows_are_counted_in_pieces(monkeypatch):
    rng = random.Random(6)
    texts = [sentences(rng, lang, n) for lang in LANGS for n in (0, 1, 40, 200)]
    codes, n = ppm.grams(texts, 3)
    monkeypatch.setattr(ppm, "PIECE", 17)
    again, m = ppm.grams(texts, 3)
    assert (codes == again).all() and (n == m).all() and n.sum() == sum(len(t.encode()) for t in texts)


def test_the_model_is_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang").dropna()
    free = ppm.fit(docs)
    tight = ppm.fit(docs, model_bytes=free.nbytes() // 4)
    assert tight.nbytes() <= free.nbytes() // 4 and len(tight.parent) > 2
    assert len(ppm.fit(docs, model_bytes=1).parent) == 2
    many = ppm.Model([f"l{i}" for i in range(150)], [ppm.grams([f"text of language {i} {chr(200 + i)}"], 3) for i in range(150)])
    many.prepare()
    assert many.lengths(["language 7 " * 50]).shape == (1, 150)


def test_pieces_of_a_long_text_add_up(monkeypatch):
    rng = random.Random(2)
    counts = [ppm.grams([sentences(rng, lang, 50)], 3) for lang in LANGS]
    model = ppm.Model(list(LANGS), counts)
    model.prepare()
    text = sentences(rng, "aa", 5000)
    whole = model.lengths([text, "x"])
    monkeypatch.setattr(ppm, "PIECE", 100)
    assert np.allclose(whole, model.lengths([text, "x"]))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ppm.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right / n > 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    rng = random.Random(3)
    rows = [(i, sentences(rng, list(LANGS)[i % 3], 20), list(LANGS)[i % 3]) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    wrong = frame.withColumn("lang", F.when(ppm.held_out("doc_id", 4, 2), "zz").otherwise(F.col("lang")))
    assert sorted(map(str, ppm.predict(frame).collect())) == sorted(map(str, ppm.predict(wrong).collect()))


def test_odd_documents(odd_docs):
    got = ppm.predict(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["lang_pred"] == by_id[4]["lang_pred"] == by_id[6]["lang_pred"] == "und"
    assert by_id[8]["lang_pred"] != "und" and by_id[8]["score"] > 0
    assert all((r["bits_per_byte"] is None) == (r["lang_pred"] == "und") for r in got)
    assert ppm.predict(odd_docs.limit(0)).count() == 0
    none = ppm.predict(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)} and {r["bits_per_byte"] for r in none} == {None}

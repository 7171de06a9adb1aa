"""Rows of one id, or of none, are dealt to many ranges; the next document stays the same."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from hopline.llm import syncmers as S
from hopline.llm.common import two_hashes

SCHEMA = "doc_id bigint, text string"


def windows_of(frame, monkeypatch):
    """Rows that each window of ``with_next`` gets."""
    specs, lead = [], F.lead
    monkeypatch.setattr(F, "lead", lambda c: specs.append(c) or F.count(F.lit(1)))
    monkeypatch.setattr(S.Window, "partitionBy", staticmethod(lambda *c: kept(*c).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    got = [int(r["next"]) for r in S.with_next(frame).collect()]
    monkeypatch.setattr(F, "lead", lead)
    return got


kept = Window.partitionBy


def rows_of(heavy):
    return [(heavy if i % 3 == 0 else i, f"text {i} " + "x" * (i % 5)) for i in range(1500)]


def test_a_heavy_id_has_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 20)
    for heavy in (None, 7, (1 << 63) - 1, -(1 << 63)):
        sizes = windows_of(spark.createDataFrame(rows_of(heavy), SCHEMA), monkeypatch)
        monkeypatch.setattr(S.Window, "partitionBy", staticmethod(kept))
        assert len(sizes) == 1500 and max(sizes) < 100


def test_next_follows_ids_and_digests(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 20)
    for heavy in (None, 7, (1 << 63) - 1, -(1 << 63)):
        frame = spark.createDataFrame(rows_of(heavy) + [(5, "same"), (5, "same")], SCHEMA)
        told = frame.select("doc_id", "text", *two_hashes(F.col("doc_id"), F.col("text"))).collect()
        order = sorted(told, key=lambda r: (-(-(1 << 63) if r["doc_id"] is None else r["doc_id"]), r["_h1"], r["_h2"]))
        want = sorted((str(a["doc_id"]), a["text"], b["text"]) for a, b in zip(order, order[1:] + order[:1]))
        assert sorted((str(r["id"]), r["text"], r["next"]) for r in S.with_next(frame).collect()) == want

"""Scopes reach from 256 code points before a part's start to 256 after its end."""
import random

import pytest

from hopline.llm import credentials as C
from tests.llm.scopes import spans

LONG = "Ab1_" * 100


def scanned(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["spans"] for r in C.digests(C.scan(frame)).orderBy("doc_id").collect()]


def test_parts_beside_a_long_secret_are_linked(spark):
    text = f"token={LONG} user: alice1 https://api.example.com"
    frame = spark.createDataFrame([(1, text, len(text))], "doc_id bigint, text string, n_chars bigint")
    assert scanned(spark, [text])[0].count("id:") == 1 and "endpoint:" in scanned(spark, [text])[0]
    assert C.redact(frame).first()["text"] == "<assign> <id> <endpoint>"


def test_a_long_weak_secret_looks_ahead_from_its_end(spark):
    text = f"{LONG} user: alice1"
    assert scanned(spark, [text])[0] == f"secret:0:400,id:401:{len(text)}"


@pytest.mark.parametrize("gap, linked", [(256, True), (257, False)])
def test_the_gap_between_parts_decides(spark, gap, linked):
    texts = [f"token={LONG}{' ' * gap}user: alice1", f"user: alice1{' ' * gap}token={LONG}", f"user: {'z' * 400}{' ' * gap}token=abcdefgh"]
    assert [("id:" in got) for got in scanned(spark, texts)] == [linked] * 3


def test_a_short_part_does_not_hide_the_end_of_a_long_one(spark):
    texts = [f"{LONG}/x=token=abcdefgh {' ' * 240}user: alice1", f"{'z' * 300}A1 user: alice1", f"{'Z' * 900}b1 login=bob99"]
    got = scanned(spark, texts)
    assert got == [spans(t) for t in texts] and "secret:0:302" in got[1] and "secret:0:902" in got[2]


def test_against_brute_force(spark):
    rng = random.Random(3)
    pieces = [f"token={LONG}", LONG, "user: alice1", "login=" + "b" * 300, "https://api.example.com", "AKIA" + "Z" * 300,
              "0123456789abcdef" * 20, "x" * 260 + "A1", "secret=abcdefgh"]
    texts = ["".join(rng.choice(pieces) + " " * rng.choice([1, 9, 120, 254, 255, 256, 257, 258, 300]) for _ in range(rng.randrange(1, 9)))
             for _ in range(120)]
    assert scanned(spark, texts) == [spans(t) for t in texts]

import hashlib
import random

from hopline.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ODD = ["", None, "a", "<|end|>\n", "<|text|>", "<\\|x", "<\\\\|", "ends with <", "|starts", "\\", "<|", "é😀", "a\nb", "$1\\"]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t), ro or "", x or "") for c, t, ro, x in rows if c == conv)
        loss = "".join(x for _, ro, x in own if ro == "assistant")
        lines = "".join(f"{ro}\n{x}\n" for _, ro, x in own)
        out[conv] = (len(own), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_any_text_and_role(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "system", None, "<|text|>"]), rng.choice(ODD))
            for c in range(40) for _ in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (-7, 0, "user", "\\### Assistant: </turn> ok")]
    rows += [rows[0], rows[0]]
    rows += [(99, i, "assistant" if i % 3 else "user", "word " * 50) for i in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS turns", "1 AS conv")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.format_chats(frame)).collect()}
    assert got == expected(rows)


def test_adjacent_turns_of_a_role_share_a_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "<|end|>")]
    row = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["formatted"] == (
        "<|turn|>user<|text|>a<|next|>b<|end|>\n<|turn|>assistant<|text|><\\|end|><|end|>\n")
    assert [s["piece"] for s in row["segments"] if s["trained"]] == ["<\\|end|>"]
    assert "".join(s["piece"] for s in row["segments"]) == row["formatted"]


def test_empty_table(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0

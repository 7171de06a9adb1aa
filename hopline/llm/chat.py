r"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted by (turn, role, text); adjacent turns of one role become one
block, and the blocks are joined to one text:

    <|turn|>role<|text|>first text<|next|>second text of the same role<|end|>\n

Control strings start with ``<|``. Inside a role or text a ``<``, any backslashes and a ``|`` get one more
backslash before the ``|``, so ``<|`` cannot occur there, and taking it off again gives the text back, whatever it holds.

``segments`` carries the loss mask: consecutive pieces of the formatted text, each marked as trained on or not.
A null role or text counts as empty, a null turn sorts first, rows with a null conversation form one conversation,
and a repeated row is a repeated turn. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def literal(control: str) -> str:
    return control.replace("|", r"\|")


def blocks(turns: Column, starts: Column) -> Column:
    """Sorted turns as (role, texts) blocks; ``starts`` holds the position of each block's first turn."""
    def block(at: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), F.size(turns))
        return F.struct(
            F.get(turns, at)["role"].alias("role"),
            F.transform(F.slice(turns, at + 1, end - at), lambda t: t["text"]).alias("texts"),
        )

    return F.transform(starts, block)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``segments`` (piece, trained)."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    turns = rows.select(F.col(conv_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(
        F.array_sort(F.collect_list("t")).alias("turns"))
    t = F.col("turns")
    starts = turns.withColumn("starts", F.filter(
        F.sequence(F.lit(0), F.size(t) - 1),
        lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]),
    ))
    merged = starts.select("conv", blocks(t, F.col("starts")).alias("blocks"))

    def piece(text: Column, marked: Column) -> Column:
        return F.struct(text.alias("piece"), marked.alias("trained"))

    def pieces(b: Column) -> Column:
        head = F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT))
        texts = F.transform(b["texts"], lambda x, i: F.array(
            piece(F.when(i == 0, head).otherwise(F.lit(NEXT)), F.lit(False)),
            piece(escape(x), b["role"] == trained),
        ))
        return F.concat(F.flatten(texts), F.array(piece(F.lit(END), F.lit(False))))

    cut = merged.select("conv", F.flatten(F.transform("blocks", pieces)).alias("segments"))
    return cut.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"),
        "segments",
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    def turns(block: Column) -> Column:
        halves = F.split(block, literal(TEXT), 2)
        role = unescape(F.substring(F.get(halves, F.lit(0)), len(TURN) + 1, 1 << 30))
        return F.transform(F.split(F.get(halves, F.lit(1)), literal(NEXT)), lambda x: F.struct(
            role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, literal(END)), lambda b: b != ""), turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped piece by piece."""
    kept = F.filter(segments, lambda s: s["trained"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["piece"])), "")


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Figures read back from the formatted conversations."""
    read = chats.select(
        conv_col, "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )

"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; neighbouring turns of one role form a block, cut out
with array functions; pieces of text and marks are concatenated. Marks look like <|start|>. In texts and roles
every run of bars after a < gets one bar more, so that no text can hold a mark, and reading takes that bar away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>\n"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)", r"<|$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", r"<$1")


def _piece(text: Column, learned: Column) -> Column:
    return F.struct(text.alias("text"), learned.alias("learned"))


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    learned_role: str = LEARNED_ROLE,
) -> DataFrame:
    """One row per conversation: conv, formatted, pieces (text, learned).

    `formatted` is <|start|>role<|text|>first text<|next|>second text<|end|> for each block of neighbouring turns of
    one role; `pieces` cut it into parts that are learned (texts of learned_role) or not, and join to it. Turns are
    sorted by (turn, role, text), null turns first; repeated rows are repeated turns; a null role or text is written
    as an empty one; rows with a null conv form a conversation of their own. An empty table gives an empty one;
    other columns are not read. A conversation is one string, so its rows meet in one task.
    """
    no = F.lit(False)
    rows = turns.select(F.col(conv).alias("conv"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).alias("said"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    begin = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (
        F.col("turns")[i]["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"]))
    whole = whole.withColumn("begin", begin)
    ends = F.concat(F.slice("begin", F.lit(2), F.greatest(F.size("begin") - 1, F.lit(0))), F.array(F.size("turns")))
    blocks = F.zip_with("begin", ends, lambda a, b: F.struct(
        F.col("turns")[a]["role"].alias("role"), F.slice("turns", a + 1, b - a).alias("turns")))

    def block(b: Column) -> Column:
        learned = b["role"] == learned_role
        texts = F.flatten(F.transform(b["turns"], lambda t, i: F.array(
            _piece(F.when(i == 0, F.concat(F.lit(START), escape(b["role"]), F.lit(TEXT))).otherwise(F.lit(NEXT)), no),
            _piece(escape(t["text"]), learned))))
        return F.concat(texts, F.array(_piece(F.lit(END), no)))

    pieces = F.flatten(F.transform(blocks, block))
    return whole.select("conv", pieces.alias("pieces")).select(
        F.col("conv").alias(conv), F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def parse_conversations(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, turns (role, text) read from `formatted`, and `learned`, the texts under the mask, unescaped."""
    def quoted(mark: str) -> str:
        return r"\Q" + mark + r"\E"

    parts = F.split("formatted", quoted(END))
    blocks = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turns_of(block: Column) -> Column:
        halves = F.split(F.replace(block, F.lit(START), F.lit("")), quoted(TEXT))
        return F.transform(F.split(halves[1], quoted(NEXT)), lambda t: F.struct(
            unescape(halves[0]).alias("role"), unescape(t).alias("text")))

    learned = F.transform(F.filter("pieces", lambda p: p["learned"]), lambda p: unescape(p["text"]))
    return formatted.select(conv, F.flatten(F.transform(blocks, turns_of)).alias("turns"), learned.alias("learned"), "formatted")


def conversation_digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests of turns and learned texts, read back from formatted conversations."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return parse_conversations(formatted, conv).select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))

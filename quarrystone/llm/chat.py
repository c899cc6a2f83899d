"""Conversations as training text with a loss mask, in DataFrame expressions only.

A conversation's turns are collected and sorted, adjacent turns of one role merged, and the parts laid
end to end. Each control string begins with `<|`. A text holds none: in it, `<`, any backslashes and `|`
get one backslash more, which reading takes away again, so every text can be read back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(rows: DataFrame, train_role: str = "assistant") -> DataFrame:
    """A row per conv_id of `rows` (conv_id, turn, role, text; others are ignored): conv_id, formatted, pieces.

    formatted is `<|im_start|>role<|im_sep|>text<|im_end|>` and a line end for each run of turns of one role; `<|im_next|>`
    stands between texts of a run. pieces (text, train) are its parts in order; train is the loss mask, true for the
    texts of `train_role` alone. Rows sort by turn (null first), then role and text, so ties and repeated rows keep a
    fixed order; null roles and texts count as empty; a null conv_id is a conversation; no rows give no result. A
    conversation is one row of the result, so it must fit in memory; its rows are gathered once.
    """
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", *[F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text")]))).alias("turns"))
    # Sorted as they are, and escaped after that.
    turns = turns.select("conv_id", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    n = F.size("turns")
    at = lambda i: F.get(F.col("turns"), i)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    cut = turns.withColumn("starts", starts)
    runs = F.transform(
        "starts",
        lambda s, j: F.struct(at(s)["role"].alias("role"), F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", j + 1), n) - s), lambda t: t["text"]).alias("texts")),
    )
    piece = lambda text, train: F.struct(text.alias("text"), train.alias("train"))
    plain = lambda text: piece(F.lit(text) if isinstance(text, str) else text, F.lit(False))

    def parts(run: Column) -> Column:
        texts = F.transform(run["texts"], lambda x, i: F.when(i == 0, F.array(piece(x, run["role"] == train_role))).otherwise(F.array(plain(NEXT), piece(x, run["role"] == train_role))))
        return F.concat(F.array(plain(F.concat(F.lit(START), run["role"], F.lit(MIDDLE)))), F.flatten(texts), F.array(plain(END)))

    pieces = cut.select("conv_id", F.flatten(F.transform(runs, parts)).alias("pieces"))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, as they were before it was formatted."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        halves = F.split(F.substring(block, len(START) + 1, F.length(block)), r"<\|im_sep\|>", -1)
        role = unescape(F.get(halves, 0))
        return F.transform(F.split(F.get(halves, 1), r"<\|im_next\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["train"]), lambda p: unescape(p["text"])), "")

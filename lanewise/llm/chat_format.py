"""Relational chat formatting: Spark expressions only, no Python on the data path.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role share one
block, in which they stay apart by a turn mark; blocks are concatenated to one string::

    <s>[>user]first turn[|]second turn[/][>assistant]answer[/]</s>

Every mark holds ``<`` or ``[``.  Inside texts and roles ``~``, ``<``, ``[`` and ``]`` are written ``~0`` to
``~3``, so no text can hold a mark and the output reads back exactly.  Under the loss mask are
the texts of assistant turns.

Defined cases: null text and null role are empty; turns sort by (turn, role, text) with nulls first,
so ties and repeated rows have one order; an empty table formats no conversation; rows of a
null id are one conversation; other columns are ignored.  A formatted conversation is one value,
so a conversation has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
BEGIN, END = "<s>", "</s>"
OPEN, OPENED, TURN, CLOSE = "[>", "]", "[|]", "[/]"
_CODES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))


def escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, code in _CODES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    for plain, code in reversed(_CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _blocks(turns: Column) -> Column:
    """Slices of ``turns`` with one role each.

    A block starts where the role differs from the turn before and ends where the next one
    starts, so the work is linear in the number of turns.
    """
    size = F.size(turns)
    starts = F.filter(
        F.sequence(F.lit(1), size),
        lambda i: (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]),
    )
    ends = F.concat(F.slice(starts, F.lit(2), size), F.array(size + 1))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.slice(turns, p["a"], p["b"] - p["a"]))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): one row per conversation of ``turns`` (conv_id, turn, role, text)."""
    rows = turns.select("conv_id", F.struct("turn", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text")).alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = listed.select("conv_id", _blocks(F.col("turns")).alias("blocks"))

    def block(b: Column) -> Column:
        texts = F.array_join(F.transform(b, lambda t: t["text"]), TURN)
        return F.concat(F.lit(OPEN), F.element_at(b, 1)["role"], F.lit(OPENED), texts, F.lit(CLOSE))

    return blocks.select("conv_id", F.concat(F.lit(BEGIN), F.array_join(F.transform("blocks", block), ""), F.lit(END)).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the turns (role, text) that the formatted string holds."""
    inner = F.expr(f"substring(formatted, {len(BEGIN) + 1}, length(formatted) - {len(BEGIN) + len(END)})")
    blocks = F.filter(F.split(inner, r"\[/\]"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), OPENED, 1)
        body = F.substr(b, F.length(role) + F.lit(len(OPEN) + len(OPENED) + 1))
        return F.transform(F.split(body, r"\[\|\]"), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"))


def chat_digest(turns: DataFrame) -> DataFrame:
    """Digests of what reads back from the formatted output, one row per conversation."""
    back = read_back(format_chats(turns))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    back = back.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), spoken.alias("spoken"), loss.alias("loss"))
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("spoken", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

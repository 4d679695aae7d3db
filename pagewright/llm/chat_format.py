"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Every assistant turn becomes an example: all turns up to it, of which only its own text is under the loss mask. Turns
after the last assistant turn (or all, without one) make one more example without a target, so that nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    """Puts one more backslash between < and | wherever only backslashes stand there: control strings can't occur, and unescape() is exact."""
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", "<$1|")


def expand(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end): examples of a conversation count from 0.

    loss_start and loss_end are code points in formatted, end exclusive, null without a target. Turns go by number
    (null first), equal ones by role and text; repeated rows stay; null roles and texts are empty; rows with a null
    conversation are one conversation. Other columns are not read. A conversation must fit in a row, since its last
    example holds all of it; examples are made one at a time.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    turns = conversations.select(F.col(conv_column).alias("conv_id"), F.struct(F.col(turn_column).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    turns = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("target"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("parts"),
    )
    tail = f"{END}\n"
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(tail)
    turns = turns.select(
        "conv_id",
        "parts",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("whole"),
        F.transform("parts", size).alias("sizes"),
    )
    n = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: F.element_at("parts", k)["target"] | (k == n))
    rows = turns.select("conv_id", "parts", "sizes", "whole", F.posexplode(ends).alias("example", "k"))
    last = F.element_at("parts", F.col("k"))
    end = F.aggregate(F.slice("sizes", 1, F.col("k")), F.lit(0), lambda a, x: a + x)
    rows = rows.select("conv_id", "example", "whole", end.alias("end"), F.when(last["target"], F.length(last["body"])).alias("loss"))
    return rows.select(
        "conv_id", "example", F.expr("left(whole, end)").alias("formatted"),
        (F.col("end") - len(tail) - F.col("loss")).alias("loss_start"), F.when(F.col("loss").isNotNull(), F.col("end") - len(tail)).alias("loss_end"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns of an example as array<struct<role,text>>, read from its text alone."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    blocks = F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda b: F.substring(b, F.lit(len(START) + 1), F.length(b)))
    role = lambda b: F.substring_index(b, "\n", 1)
    return F.transform(
        blocks,
        lambda b: F.struct(unescape(F.replace(role(b), F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(F.substring(b, F.length(role(b)) + 2, F.length(b))).alias("text")),
    )


def digest(examples: DataFrame) -> DataFrame:
    """The contract's columns, read back from the examples: turns from a conversation's last one, losses from all."""
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    rows = examples.select("conv_id", "example", "formatted", loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    rows = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"),
    )
    rows = rows.select("conv_id", turns_of(F.col("whole")).alias("turns"), "loss", "formatted_chars")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )

"""Preference formatting of chat conversations, with DataFrame functions only.

For a chosen and a rejected conversation the longest common turn prefix (equal
role and text, turn by turn) is rendered once as prompt; what follows on either
side is rendered as a completion with a loss mask: the character ranges of the
assistants' texts inside it.

A pair is one output row, so its turns meet in one task; pairs are independent of each other.

Defined results: turns are ordered by turn, then role, then text (nulls first);
null roles and texts render as empty and equal each other; a side without
turns gives an empty completion; repeated rows are repeated turns, and turns that
tie are equal; very long texts are rendered whole; an empty table gives no pairs;
paired() leaves out rows without a conversation id, which belong to no
conversation; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turn: Column) -> Column:
    return F.concat(head(turn), turn["text"], F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask(turns: Column) -> Column:
    """Ranges "from-to" (characters, to excluded) of assistant texts in render(turns), comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        a = acc["at"] + F.length(head(t))
        z = a + F.length(t["text"])
        mine = F.when(t["role"] == "assistant", F.array(F.concat_ws("-", a.cast("string"), z.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct((acc["at"] + F.length(rendered(t))).alias("at"), F.concat(acc["out"], mine).alias("out"))

    return F.array_join(F.aggregate(turns, start, step)["out"], ",")


def preferences(pairs: DataFrame) -> DataFrame:
    """From rows (pair_id, side "chosen" or "rejected", turn, role, text): one formatted row per pair."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def side(name: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col("side") == name, turn)))
        return F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name)

    both = pairs.groupBy("pair_id").agg(side("chosen"), side("rejected"))
    shared = F.least(F.size("chosen"), F.size("rejected"))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(shared, F.lit(1))), lambda i: F.get("chosen", i - 1) != F.get("rejected", i - 1))
    both = both.withColumn("n_prefix", F.when(shared == 0, 0).when(F.size(differ) > 0, F.element_at(differ, 1) - 1).otherwise(shared))

    def rest(name: str) -> Column:
        return F.slice(name, F.col("n_prefix") + 1, F.greatest(F.size(name) - F.col("n_prefix"), F.lit(0)))

    return both.select(
        "pair_id",
        F.col("n_prefix").cast("long").alias("n_prefix"),
        render(F.slice("chosen", F.lit(1), F.col("n_prefix"))).alias("prompt"),
        render(rest("chosen")).alias("chosen"),
        mask(rest("chosen")).alias("chosen_mask"),
        render(rest("rejected")).alias("rejected"),
        mask(rest("rejected")).alias("rejected_mask"),
    )


def paired(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and rejected side of pair k; rows without an id belong to none."""
    conv = F.col("conv_id").cast("long")
    side = F.when(F.pmod(conv, F.lit(2)) == 1, "rejected").otherwise("chosen")
    return conversations.filter(conv.isNotNull()).select(F.shiftright(conv, 1).alias("pair_id"), side.alias("side"), "turn", "role", "text")

"""Preference pairs: a shared prompt and two completions with masks.

Chosen and rejected conversations are compared turn by turn; their longest common prefix of turns
is rendered once as the prompt, and what remains of each is a completion whose mask marks the
characters that a model should learn: the assistant's texts with their end marks.

Main path: DataFrame functions. A conversation is a record of its own; pairs are given or follow
from ids, so that a group of many equal conversations is never paired with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the turn format
START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"


def gathered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns: an array of (role, text) in order. Null roles and texts count as empty,
    null turns come first, ties go by role and text; rows without a conversation's id make none."""
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns are equal."""
    most = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.when(most > 0, F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.get(a, i) == F.get(b, i))).otherwise(F.array().cast("array<boolean>")), False)
    return F.when(differs > 0, differs - 1).otherwise(most).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def learned_spans(turns: Column) -> Column:
    """(first, one past the last) character of each assistant text with its end mark, in the rendered turns."""
    head = lambda t: F.lit(len(START) + 1) + F.char_length(t["role"])
    full = lambda t: head(t) + F.char_length(t["text"]) + len(END)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,end:int,own:boolean>>").alias("spans"))
    step = lambda s, t: F.struct(
        (s["at"] + full(t)).alias("at"),
        F.concat(s["spans"], F.array(F.struct((s["at"] + head(t)).alias("first"), (s["at"] + full(t)).alias("end"), (t["role"] == LEARNED).alias("own")))).alias("spans"),
    )
    return F.transform(F.filter(F.aggregate(turns, zero, step)["spans"], lambda x: x["own"]), lambda x: F.struct(x["first"].alias("first"), x["end"].alias("end")))


def learns(turns: Column) -> Column:
    """Whether some turn is the assistant's."""
    return F.exists(turns, lambda t: t["role"] == LEARNED)


def format_preferences(pairs: DataFrame, conversations: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans, usable.

    pairs: pair_id, chosen and rejected (ids of conversations); conversations: as `gathered` gives
    them. A conversation that is null or missing has no turns: nothing is common, its completion
    is empty. Equal conversations leave two empty completions. usable says whether both completions
    hold something to learn; one-sided and equal pairs are not. An empty table gives an empty result.
    """
    side = lambda name: conversations.select(F.col("conv_id").alias(name), F.col("turns").alias(f"{name}_turns"))
    both = pairs.join(side("chosen"), "chosen", "left").join(side("rejected"), "rejected", "left")
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = both.select("pair_id", F.coalesce("chosen_turns", none).alias("c"), F.coalesce("rejected_turns", none).alias("r"))
    both = both.select("*", F.explode(F.array(common_turns(F.col("c"), F.col("r")))).alias("n_common"))
    rest = lambda x: F.slice(x, F.col("n_common") + 1, F.greatest(F.size(x) - F.col("n_common"), F.lit(0)))
    both = both.select("pair_id", "n_common", F.slice("c", F.lit(1), F.col("n_common")).alias("p"), rest(F.col("c")).alias("c"), rest(F.col("r")).alias("r"))
    return both.select("pair_id", "n_common", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"), learned_spans(F.col("c")).alias("chosen_spans"), learned_spans(F.col("r")).alias("rejected_spans"), (learns(F.col("c")) & learns(F.col("r"))).alias("usable"))


def neighbouring_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs for a table without preferences: of the ids 2p and 2p + 1 the even one is chosen."""
    p = F.floor(F.col("conv_id") / 2)
    return conversations.groupBy(p.alias("pair_id")).agg(F.max(F.when(F.col("conv_id") % 2 == 0, F.col("conv_id"))).alias("chosen"), F.max(F.when(F.col("conv_id") % 2 != 0, F.col("conv_id"))).alias("rejected"))

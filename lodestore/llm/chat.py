"""Preference pairs in chat format, on column expressions alone (operator 7).

The longest common prefix of whole turns of a chosen and a rejected conversation is
rendered once as the prompt; what follows is rendered as two completions. The mask of
a completion lists the character spans that carry loss: text and end mark of assistant
turns, not the headers and not other roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns, an array of (role, text) in the order of turn, then role
    and text. Null texts are empty, null roles "unknown"; rows without conv_id belong
    to no conversation; repeated rows are repeated turns."""
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("listed"))
    return listed.select("conv_id", F.transform("listed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    shorter = F.least(F.size(a), F.size(b))
    differs = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: ~x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(differs, F.lit(True)), F.lit(0)) - 1, shorter).cast("int")


def _header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t["role"]), t["text"], F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """Spans (start, end) of the rendered turns that carry loss."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_header(t["role"]))
        end = begin + F.length(t["text"]) + len(END)
        span = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, and for chosen and rejected the completion and
    its mask. ``pairs`` has pair_id, chosen and rejected (arrays of role, text); a null
    array is an empty conversation. If one is the beginning of the other its
    completion is empty; equal ones have two empty completions."""
    empty = F.array().cast(TURNS)
    clean = pairs.select("pair_id", F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    common = clean.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.size(c))
    parts = common.select("pair_id", "prompt_turns", F.slice("chosen", 1, F.col("prompt_turns")).alias("head"), rest(F.col("chosen")).alias("chosen"), rest(F.col("rejected")).alias("rejected"))
    return parts.select(
        "pair_id", "prompt_turns", render(F.col("head")).alias("prompt"),
        render(F.col("chosen")).alias("chosen_completion"), loss_spans(F.col("chosen")).alias("chosen_mask"),
        render(F.col("rejected")).alias("rejected_completion"), loss_spans(F.col("rejected")).alias("rejected_mask"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: a conversation is chosen; rejected is
    the same one with its last assistant turn and what follows replaced by the last
    assistant turn of the conversation with the next number (none if there is none).
    Conversations without assistant turn give no pair."""
    convs = conversations(turns)
    at = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"] == "assistant"), F.lit(True)) + 1
    answered = convs.where(F.exists("turns", lambda t: t["role"] == "assistant")).withColumn("at", at.cast("int"))
    answers = answered.select(F.try_subtract("conv_id", F.lit(1)).alias("before"), F.element_at("turns", F.col("at")).alias("other"))
    joined = answered.join(answers, F.col("conv_id") == F.col("before"), "left")
    swapped = F.concat(F.slice("turns", 1, F.col("at") - 1), F.when(F.col("other").isNull(), F.array().cast(TURNS)).otherwise(F.array("other").cast(TURNS)))
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), swapped.alias("rejected"))

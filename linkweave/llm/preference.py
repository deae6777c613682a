"""Chat formatting of preference pairs, in DataFrame functions.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (same
role, same text) is rendered once as the prompt; what follows on each side is rendered as a
completion, with a mask: the code-point spans of the completion that are assistant text and
so count in the loss.

Defined cases: turns are ordered by (turn, role, text), so repeated turn numbers have one
order; a null role is rendered as ``unknown`` and a null text as empty; rows with a null
conversation id belong to no conversation and are left out; sides without a difference have
status ``identical`` and two empty completions; a side that ends within the common prefix has
an empty completion and status ``no_chosen`` or ``no_rejected``; no rows give no rows; other
columns of the turns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<turn:bigint,role:string,text:string>>"
#: Fixed template: what stands before and after the text of a turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column, trained_role: str = "assistant") -> Column:
    """Spans of the rendered turns that hold the trained role's text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_head(t["role"]))
        end = begin + F.length(t["text"])
        own = F.array(F.struct(begin.alias("start"), end.alias("stop")))
        return F.struct((end + F.length(F.lit(CLOSE))).alias("at"), F.when(t["role"] == trained_role, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that are the same in both."""
    n = F.least(F.size(a), F.size(b))
    places = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    differs = lambda i: ~(F.try_element_at(a, i)["role"].eqNullSafe(F.try_element_at(b, i)["role"]) & F.try_element_at(a, i)["text"].eqNullSafe(F.try_element_at(b, i)["text"]))
    return F.coalesce(F.array_min(F.filter(places, differs)) - 1, n)


def conversations(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns) with each conversation's turns in order."""
    one = F.struct(F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return turns.where(F.col(conv_id).isNotNull()).groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def format_preferences(pairs: DataFrame, *, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with array columns of turns, as prompt, masked completions and status."""
    shared, a, b = F.col("n_prompt_turns"), F.col(chosen), F.col(rejected)
    rest = lambda side: F.slice(side, shared + 1, F.greatest(F.size(side), F.lit(1)))
    status = F.when((F.size(a) == shared) & (F.size(b) == shared), "identical").when(F.size(a) == shared, "no_chosen").when(F.size(b) == shared, "no_rejected").otherwise("ok")
    others = [c for c in pairs.columns if c not in (chosen, rejected)]
    return pairs.withColumn("n_prompt_turns", common_turns(a, b)).select(
        *others,
        status.alias("status"),
        "n_prompt_turns",
        render(F.slice(a, F.lit(1), shared)).alias("prompt"),
        render(rest(a)).alias("chosen"),
        mask(rest(a)).alias("chosen_mask"),
        render(rest(b)).alias("rejected"),
        mask(rest(b)).alias("rejected_mask"),
    )


def reply_swaps(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation against itself with its last assistant turn
    swapped for that of its neighbour, the conversation whose id differs in the last bit.

    The replies are aggregated on their own, so the turns shuffle once as whole conversations.
    Without an assistant turn, or without a neighbour that has one, the rejected side just ends
    before the turn. Each conversation meets one other, so nothing grows with a group's size.
    """
    own = conversations(turns)
    last = F.array_max(F.transform(F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"))), lambda x: x["role"] == "assistant"), lambda x: x["i"]))
    own = own.withColumn("last", last)
    # the last assistant turn by the order of the turns; one text a conversation leaves a map task
    said = turns.where("conv_id is not null and role = 'assistant'").select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    reply = said.groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("reply"))
    partner = reply.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("bigint")).alias("of_id"), "reply")
    joined = own.join(partner, own.conv_id == partner.of_id, "left")
    before = F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.slice("turns", F.lit(1), F.coalesce("last", F.lit(0))))
    was = F.try_element_at("turns", F.col("last") + 1)
    swapped = F.array(F.struct(was["turn"].alias("turn"), was["role"].alias("role"), F.col("reply").alias("text")))
    after = F.slice("turns", F.coalesce("last", F.lit(0)) + 2, F.greatest(F.size("turns"), F.lit(1)))
    rejected = F.when(F.col("last").isNull() | F.col("reply").isNull(), before).otherwise(F.concat(before, swapped, after))
    return joined.select("conv_id", F.col("turns").cast(TURN).alias("chosen"), rejected.cast(TURN).alias("rejected"))


def preference_report(turns: DataFrame) -> DataFrame:
    """One row per conversation of the table; masks as ``start-stop`` lists."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
    return format_preferences(reply_swaps(turns)).withColumn("n_prompt_turns", F.col("n_prompt_turns").cast("bigint")).withColumn("chosen_mask", text("chosen_mask")).withColumn("rejected_mask", text("rejected_mask"))

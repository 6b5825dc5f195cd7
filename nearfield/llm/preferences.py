"""Preference formatting in DataFrame functions only.

A chosen and a rejected conversation are compared turn by turn. Their longest common prefix
is rendered once as the prompt; what follows on either side is rendered as a completion, with
the stretches of it that count towards the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn:", "<|end|>\n"
#: Turns summed at a time where offsets are made.
_GROUP = 64


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _shown), "")


def _shown(t: Column) -> Column:
    return F.concat(_head(t), t["text"], F.lit(CLOSE))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("|>"))


def _mask(turns: Column, role: str) -> Column:
    """start:end pairs, in code points of the completion, of the text and close of each turn of `role`.

    Ends are running sums, added up within groups of turns and over groups, so that long
    conversations stay cheap.
    """
    sizes = F.transform(turns, lambda t: F.length(_shown(t)))
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.size(turns) / _GROUP).cast("int")), lambda i: F.slice(sizes, i * _GROUP + 1, F.lit(_GROUP)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    sums = F.transform(groups, total)
    spans = F.transform(
        groups,
        lambda g, i: F.transform(g, lambda x, j: total(F.slice(sums, F.lit(1), i)) + total(F.slice(g, F.lit(1), j + 1))),
    )
    ends = F.flatten(spans)
    masks = F.zip_with(turns, ends, lambda t, end: F.when(t["role"] == role, F.concat_ws(":", end - F.length(_shown(t)) + F.length(_head(t)), end)))
    return F.array_join(F.filter(masks, lambda x: x.isNotNull()), ",")


def _turn() -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return F.struct(F.col("turn").cast("long").alias("turn"), text("role"), text("text")).alias("t")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns, ordered by turn; null texts and roles are empty, repeated turns stay."""
    return conversations.select("conv_id", _turn()).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def format_preferences(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """Of rows pair_id, chosen, rejected (arrays of turn, role, text): pair_id, n_prompt, prompt,
    chosen, chosen_mask, rejected, rejected_mask.

    Turns agree if role and text do. The prompt is the longest common prefix; if one
    conversation is the other's prefix, its completion is empty. Masks list the start:end
    stretches, in code points of a completion, that turns of the role `trained` train. A null
    conversation counts as one without turns. Each row gives one row, repeated ones too.
    """
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    a, b = F.coalesce("chosen", empty), F.coalesce("rejected", empty)
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    common = F.coalesce(F.array_position(same, False), F.lit(0)).cast("int")
    rows = pairs.select("pair_id", a.alias("a"), b.alias("b"), F.when(common > 0, common - 1).otherwise(F.size(same)).alias("n_prompt"))
    rest = lambda c: F.slice(c, F.col("n_prompt") + 1, F.size(c))
    rows = rows.select("pair_id", "n_prompt", F.slice("a", F.lit(1), F.col("n_prompt")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return rows.select(
        "pair_id",
        F.col("n_prompt").cast("long").alias("n_prompt"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("a")).alias("chosen"),
        _mask(F.col("a"), trained).alias("chosen_mask"),
        _render(F.col("b")).alias("rejected"),
        _mask(F.col("b"), trained).alias("rejected_mask"),
    )


def swapped_replies(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """Pairs of each conversation and itself with its closing reply replaced by a neighbour's.

    The neighbour of conv_id is conv_id with its lowest bit flipped. Where it has no reply, or
    the conversation doesn't close with one, nothing takes the reply's place.
    """
    own = turns_of(conversations)
    last = F.element_at("turns", -1)
    answers = conversations.where(F.col("role") == trained).select(F.col("conv_id").bitwiseXOR(1).alias("conv_id"), _turn())
    reply = answers.groupBy("conv_id").agg(F.max("t").alias("reply"))
    closes = F.coalesce(last["role"] == trained, F.lit(False))
    kept = F.when(closes, F.slice("turns", F.lit(1), F.size("turns") - 1)).otherwise(F.col("turns"))
    other = F.when(closes & F.col("reply").isNotNull(), F.concat(kept, F.array("reply"))).otherwise(kept)
    return own.join(reply, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), other.alias("rejected"))

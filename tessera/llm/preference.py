"""Preference formatting: the longest common turn prefix as prompt, paired completions with loss masks.

Everything here is DataFrame expressions; turns are arrays of struct<role, text>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import materialize, read

#: How a turn is rendered: opening with the role, text, closing.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"
#: The role whose turns are trained on.
TRAINED = "assistant"
#: Turns that are folded into one array of spans; longer conversations are folded block by block.
FOLD_TURNS = 256


def _role(turn: Column) -> Column:
    return F.coalesce(turn["role"], F.lit("unknown"))


def _text(turn: Column) -> Column:
    return F.coalesce(turn["text"], F.lit(""))


def rendered(turns: Column) -> Column:
    parts = F.transform(turns, lambda t: F.concat(F.lit(OPEN), _role(t), F.lit(AFTER_ROLE), _text(t), F.lit(CLOSE)))
    return F.concat_ws("", parts)


def mask(turns: Column) -> Column:
    """Spans start:end of code points of the rendered turns that count in the loss: texts and closings of the trained role."""
    size = lambda t: F.length(_role(t)) + F.length(_text(t)) + len(OPEN + AFTER_ROLE + CLOSE)
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    step = lambda x, t: F.struct(
        (x["at"] + size(t)).alias("at"),
        F.when(_role(t) == TRAINED, F.concat(x["spans"], F.array(span(x["at"] + F.length(_role(t)) + len(OPEN + AFTER_ROLE), x["at"] + size(t))))).otherwise(x["spans"]).alias("spans"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))
    # A fold copies the array that it extends, so turns are folded in blocks, and blocks are moved to their places.
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(turns) / FOLD_TURNS).cast("int") - 1, F.lit(0)))
    folded = F.transform(parts, lambda i: F.aggregate(F.slice(turns, i * FOLD_TURNS + 1, FOLD_TURNS), zero, step))
    moved = F.aggregate(
        folded,
        zero,
        lambda x, y: F.struct((x["at"] + y["at"]).alias("at"), F.concat(x["spans"], F.array(span(x["at"], x["at"]))).alias("spans")),
        lambda x: x["spans"],
    )
    spans = F.flatten(F.zip_with(folded, moved, lambda x, to: F.transform(x["spans"], lambda s: F.concat_ws(":", (s["a"] + to["a"]).cast("string"), (s["b"] + to["a"]).cast("string")))))
    return F.concat_ws(",", spans)


def common_turns(a: Column, b: Column) -> Column:
    """The number of leading turns that are equal; nulls equal each other."""
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    least = F.least(F.size(a), F.size(b))
    first = F.array_position(F.slice(same, 1, F.greatest(least, F.lit(1))), False)
    return F.when(least == 0, 0).when(first == 0, least).otherwise(first - 1).cast("int")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Renders pairs(chosen, rejected: array<struct<role, text>>, and any other columns, which are kept).

    Adds prompt, prompt_turns, chosen_text, rejected_text, chosen_mask, rejected_mask in place of the two arrays. A null
    array is a conversation without turns, a null role is "unknown", a null text is empty. Pairs that are equal in every
    turn hold no preference and are left out; one that is a prefix of the other has an empty completion. Repeated rows stay.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    kept = [F.col(f"`{c}`") for c in pairs.columns if c not in ("chosen", "rejected")]
    turns = pairs.select(*kept, F.coalesce("chosen", none).alias("_chosen"), F.coalesce("rejected", none).alias("_rejected"))
    turns = turns.withColumn("prompt_turns", common_turns(F.col("_chosen"), F.col("_rejected")))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.size(c) + 1)
    turns = turns.where((F.size("_chosen") > F.col("prompt_turns")) | (F.size("_rejected") > F.col("prompt_turns")))
    turns = turns.withColumns({"_prompt": F.slice("_chosen", 1, F.col("prompt_turns")), "_good": rest(F.col("_chosen")), "_bad": rest(F.col("_rejected"))})
    return turns.select(
        *kept,
        "prompt_turns",
        rendered(F.col("_prompt")).alias("prompt"),
        rendered(F.col("_good")).alias("chosen_text"),
        rendered(F.col("_bad")).alias("rejected_text"),
        mask(F.col("_good")).alias("chosen_mask"),
        mask(F.col("_bad")).alias("rejected_mask"),
    )


def parted_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from conversations(conv_id, turn, role, text), one for each conversation with a reply: chosen is the whole
    conversation; rejected is the same up to a reply, and from there on the next conversation from a reply of its own. Which
    reply follows from conv_id and the number of replies, so that pairs part at different turns.

    The next conversation is the one with the next id among those with a reply, after the last the first. Turns with equal
    numbers go by role and text; rows without conv_id are left out; an empty table gives no rows. A conversation is one
    example and has to fit a row; it is in two pairs whatever its length.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    whole = rows.groupBy("conv_id").agg(turns.alias("turns"))
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"].eqNullSafe(F.lit(TRAINED)))
    some = whole.withColumn("replies", replies).where(F.size("replies") > 0)
    at = F.element_at("replies", F.pmod("conv_id", F.size("replies")).cast("int") + 1)
    some = materialize(some.select("conv_id", "turns", at.alias("at")), "conversations")
    ids = materialize(numbered(some.select("conv_id"), [], ["conv_id"], "n"), "conversation-ids")
    after = ids.select(F.col("conv_id").alias("other_id"), F.col("n").alias("next"))
    following = ids.withColumn("next", F.pmod(F.col("n"), F.lit(max(1, ids.count()))) + 1).join(after, "next").select("conv_id", "other_id")
    tail = some.select(F.col("conv_id").alias("other_id"), F.slice("turns", F.col("at"), F.size("turns")).alias("tail"))
    both = some.join(following, "conv_id").join(tail, "other_id")
    return both.select("conv_id", "other_id", F.col("turns").alias("chosen"), F.concat(F.slice("turns", 1, F.col("at") - 1), "tail").alias("rejected"))


def op10_preference_pairs(spark, sf_dir: str) -> DataFrame:
    return format_pairs(parted_pairs(read(spark, sf_dir, "conversations")))


OP10_SQL = r"""
WITH whole AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), replies AS (
  SELECT conv_id, turns, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS r FROM whole
), chosen_reply AS (
  SELECT conv_id, turns, r[1 + (conv_id % len(r) + len(r)) % len(r)] AS part FROM replies WHERE len(r) > 0
), following AS (
  SELECT conv_id, turns, part, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS other_id FROM chosen_reply
), pairs AS (
  SELECT a.conv_id, a.other_id, a.turns AS chosen, list_concat(a.turns[1:a.part - 1], b.turns[b.part:]) AS rejected
  FROM following a JOIN chosen_reply b ON b.conv_id = a.other_id
), differ AS (
  SELECT *, list_filter(range(1, greatest(len(chosen), len(rejected)) + 1), lambda i: chosen[i] IS DISTINCT FROM rejected[i])[1] AS cut_at FROM pairs
), split AS (
  SELECT conv_id, other_id, CAST(cut_at - 1 AS INTEGER) AS prompt_turns, chosen[1:cut_at - 1] AS p, chosen[cut_at:] AS g, rejected[cut_at:] AS b FROM differ WHERE cut_at IS NOT NULL
), parts AS (
  SELECT *, list_transform(p, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || chr(10) || '<|end|>' || chr(10)) AS pr,
    list_transform(g, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || chr(10) || '<|end|>' || chr(10)) AS gr,
    list_transform(b, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || chr(10) || '<|end|>' || chr(10)) AS br
  FROM split
)
SELECT conv_id, other_id, prompt_turns, array_to_string(pr, '') AS prompt, array_to_string(gr, '') AS chosen_text, array_to_string(br, '') AS rejected_text,
  array_to_string(list_transform(list_filter(range(1, len(g) + 1), lambda i: g[i].role = 'assistant'),
    lambda i: CAST(length(array_to_string(gr[1:i - 1], '')) + 14 AS VARCHAR) || ':' || CAST(length(array_to_string(gr[1:i], '')) AS VARCHAR)), ',') AS chosen_mask,
  array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: b[i].role = 'assistant'),
    lambda i: CAST(length(array_to_string(br[1:i - 1], '')) + 14 AS VARCHAR) || ':' || CAST(length(array_to_string(br[1:i], '')) AS VARCHAR)), ',') AS rejected_mask
FROM parts
"""

"""Preference formatting: one shared prompt, two masked completions.

A pair is two conversations (arrays of turns). Their longest common prefix of equal turns (role and text) is rendered
once as the prompt; what follows it in each conversation is that side's completion, with the character ranges that
carry loss (the text and the closing mark of assistant turns). Everything is a column expression of one row.

Defined results: null conversations are empty; null role or text compares equal to null and renders as empty;
if one side is a prefix of the other, or both are equal, its completion is empty and ``degenerate`` is true; an empty
table gives an empty result. Turn order: turn, then role and text; rows without conv_id form no conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_of, cut, following

OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and its turns in order, from one row per turn (conv_id, turn, role, text)."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.filter("conv_id is not null").groupBy("conv_id").agg(turns.alias("_all")).select("conv_id", F.expr("transform(_all, t -> struct(t.role as role, t.text as text))").alias("turns"))


def mismatched_pairs(convs: DataFrame, rows: int = 256) -> DataFrame:
    """Chosen: a conversation up to its last assistant turn. Rejected: the same, ended by the last assistant turn of
    the next conversation (ascending conv_id, the last one takes the first's). conv_id is an integer. A conversation without
    an assistant turn has no reply to compare, so it forms no pair.

    The next one is found per block of ids, about ``rows`` in each, and for a block's last row by the next block's first id;
    replies are fetched for those ids only, so what is ordered across blocks are ids."""
    ends = convs.withColumn("_last", F.expr("array_max(filter(sequence(0, size(turns)), i -> get(turns, i).role = 'assistant'))")).filter("_last is not null")
    ends = ends.select(F.col("conv_id").cast("long").alias("conv_id"), F.expr("slice(turns, 1, _last + 1)").alias("chosen"), F.expr("get(turns, _last)").alias("_reply"))
    ids = cut(convs.filter("exists(turns, t -> t.role = 'assistant')").select(F.col("conv_id").cast("long").alias("conv_id")))
    block = block_of(ids, "conv_id", rows).alias("_block")
    firsts = cut(ids.groupBy(block).agg(F.min("conv_id").alias("_first")))
    after = following(firsts, "_first", "_id").join(firsts, "_first").select("_block", "_id")
    beyond = after.join(ends.select(F.col("conv_id").alias("_id"), F.col("_reply").alias("_beyond")), "_id").select("_block", "_beyond")
    found = ends.select("*", block).withColumn("_next", F.lead("_reply").over(Window.partitionBy("_block").orderBy("conv_id"))).join(beyond, "_block")
    return found.select("conv_id", "chosen", F.expr("concat(slice(chosen, 1, size(chosen) - 1), array(coalesce(_next, _beyond)))").alias("rejected"))


def _rendered(turns: str) -> str:
    return f"transform({turns}, t -> concat('<|', coalesce(t.role, ''), '|>\\n', coalesce(t.text, ''), '<|end|>\\n'))"


def _mask(turns: str) -> str:
    """Ranges [start, end) of characters with loss. Lengths before a turn are summed once per turn."""
    head = "length(coalesce(get({0}, i).role, '')) + 5"
    size = f"(length(coalesce(t.role, '')) + length(coalesce(t.text, '')) + 13)"
    return f"""filter(transform(sequence(0, size({turns})), i -> if(get({turns}, i).role = 'assistant',
        struct(aggregate(slice({turns}, 1, i), 0, (a, t) -> a + {size}) + {head.format(turns)} as start,
               aggregate(slice({turns}, 1, i + 1), 0, (a, t) -> a + {size}) as end), null)), x -> x is not null)"""


def format_preferences(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """From (key, chosen, rejected): key, n_prompt_turns, prompt, both completions, both masks, degenerate."""
    turn = "array<struct<role: string, text: string>>"
    both = pairs.select(key, F.coalesce("chosen", F.array().cast(turn)).cast(turn).alias("c"), F.coalesce("rejected", F.array().cast(turn)).cast(turn).alias("r"))
    shared = "coalesce(array_min(filter(sequence(0, least(size(c), size(r))), i -> not (get(c, i) <=> get(r, i)) or i = least(size(c), size(r)))), 0)"
    split = both.withColumn("n", F.expr(shared))
    split = split.select(key, "n", F.expr("slice(c, 1, n)").alias("p"), F.expr("slice(c, n + 1, size(c))").alias("c"), F.expr("slice(r, n + 1, size(r))").alias("r"))
    return split.select(
        key,
        F.col("n").cast("long").alias("n_prompt_turns"),
        F.expr(f"array_join({_rendered('p')}, '')").alias("prompt"),
        F.expr(f"array_join({_rendered('c')}, '')").alias("chosen"),
        F.expr(f"array_join({_rendered('r')}, '')").alias("rejected"),
        F.expr(_mask("c")).alias("chosen_mask"),
        F.expr(_mask("r")).alias("rejected_mask"),
        F.expr("size(c) = 0 or size(r) = 0").alias("degenerate"),
    )

"""Preference formatting: a shared prompt and two masked completions.

Chosen and rejected conversations of a pair are compared turn by turn. The turns
before the first difference form the prompt and are rendered once; the turns
from there on are the completions, with a mask over what is trained on.

``segments`` has a row for each rendered turn, so that no conversation is
gathered in one place; the first difference is a minimum that is combined
before it is shuffled. ``paired`` puts prompt and both completions side by side,
``TURNS`` turn numbers a row, so that an ordinary pair is one row and the
longest ones take several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored

START, END = "<|im_start|>", "<|im_end|>"
#: Role whose words are trained on in a completion.
TRAINED = "assistant"
#: Turn numbers that ``paired`` puts in one row.
TURNS = 1_000


def inert(text: Column) -> Column:
    """Text whose marks are no longer marks."""
    return F.replace(F.replace(text, F.lit(START), F.lit("<|im_start |>")), F.lit(END), F.lit("<|im_end |>"))


def segments(turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``pair_id, part, turn, rendered, mask_start, mask_stop, n_prompt`` for each turn that is rendered.

    ``part`` is ``prompt``, ``chosen`` or ``rejected``. ``mask_start`` and
    ``mask_stop`` bound the trained code points of ``rendered`` (equal: none).
    ``n_prompt`` counts the turns of the pair's prompt.

    Turns are aligned by number, which may be any whole number. Rows that share
    one are compared as a bag, row by row, so their order does not matter. A null
    turn number comes last, a null role is ``unknown``, a null text is empty. A
    conversation without a partner has no prompt; so have rows of a null pair. If
    one conversation begins the other, its completion has no rows. Other columns
    are not read. An empty table gives none.
    """
    side = F.coalesce(chosen, F.lit(False))
    own = turns.select(pair.cast("long").alias("pair_id"), side.alias("chosen"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    at = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"))
    said = own.where("pair_id is not null").groupBy("pair_id", "turn", "role", "text").agg(F.count_if("chosen").alias("c"), F.count_if(~F.col("chosen")).alias("r"))
    bags = stored(said.select("pair_id", "turn", "c", "r"), "bags")
    firsts = bags.groupBy("pair_id").agg(F.min(F.when(F.col("c") != F.col("r"), at)).alias("first"), F.sum(F.col("c") + F.col("r")).alias("n"))
    before = F.col("first").isNull() | (at < F.col("first"))
    prompts = hot_join(bags, firsts, ["pair_id"], "n").groupBy("pair_id", "first", "n").agg(F.coalesce(F.sum(F.when(before, F.col("c"))), F.lit(0)).alias("n_prompt"))
    pairs = stored(prompts, "pairs")
    placed = hot_join(own, pairs, ["pair_id"], "n", "left").withColumn("in_prompt", F.col("pair_id").isNotNull() & before)
    head, body = F.concat(F.lit(START), inert(F.col("role")), F.lit("\n")), F.concat(inert(F.col("text")), F.lit(END))
    trained = (F.col("role") == TRAINED) & ~F.col("in_prompt")
    return placed.where("chosen or not in_prompt").select(
        "pair_id",
        F.when(F.col("in_prompt"), "prompt").when(F.col("chosen"), "chosen").otherwise("rejected").alias("part"),
        "turn",
        F.concat(head, body, F.lit("\n")).alias("rendered"),
        F.when(trained, F.length(head)).otherwise(0).alias("mask_start"),
        F.when(trained, F.length(head) + F.length(body)).otherwise(0).alias("mask_stop"),
        F.coalesce("n_prompt", F.lit(0)).cast("long").alias("n_prompt"),
    )


def paired(made: DataFrame, turns: int = TURNS) -> DataFrame:
    """``pair_id, block, prompt, chosen, chosen_mask, rejected, rejected_mask`` from ``segments``.

    A row holds the pair's turns with numbers from ``block * turns`` up to the
    next block (null: those without a number). Masks are arrays of ``start, stop``
    in code points of their text. Turns with one number are in the order of their
    text. Rows without a pair are left out, as there is nothing to pair them with.
    """
    part = lambda name: F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("turn", "rendered", "mask_start", "mask_stop")))).alias(name)
    block = F.floor(F.col("turn") / F.lit(turns)).cast("long").alias("block")
    found = made.where("pair_id is not null").groupBy("pair_id", block).agg(*map(part, ("prompt", "chosen", "rejected")))
    text = lambda x: F.array_join(F.transform(x, lambda t: t["rendered"]), "")
    spans = lambda x: F.expr(
        f"""aggregate({x}, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,stop:int>>)),
          (acc, t) -> named_struct('at', acc.at + length(t.rendered), 'out', if(t.mask_stop > t.mask_start,
            array_append(acc.out, named_struct('start', acc.at + t.mask_start, 'stop', acc.at + t.mask_stop)), acc.out)), acc -> acc.out)"""
    )
    return found.select("pair_id", "block", text("prompt").alias("prompt"), text("chosen").alias("chosen"), spans("chosen").alias("chosen_mask"), text("rejected").alias("rejected"), spans("rejected").alias("rejected_mask"))

"""Conversation trimming: first turn, newest state block, last turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from offerloom import constants as K
from offerloom.functions import envelopes
from offerloom.operators.skew import top_rows

c = F.col
LEDGER = "[Earlier turns elided. Decisions confirmed so far:]\n<state>%s</state>"


def trim(turns: DataFrame, head: int = K.KEEP_HEAD_TURNS, tail: int = K.KEEP_TAIL_TURNS) -> DataFrame:
    """turns(conv_id, turn, role, text) -> kept rows plus one synthetic ledger row per trimmed conversation.

    Head and tail are row limits per conversation; the newest state is an aggregate over the middle,
    else over the tail. No window spans a whole conversation.
    """
    key = ["conv_id"]
    sizes = turns.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    first = top_rows(turns, key, [c("turn").asc()], head, "_k").drop("_k")
    last = top_rows(turns, key, [c("turn").desc()], head + tail, "_k")
    short = last.join(sizes.where(c("n") <= head + tail), key, "left_semi").drop("_k")
    long = sizes.where(c("n") > head + tail)
    kept_head = first.join(long, key, "left_semi")
    kept_tail = last.where(c("_k") <= tail).drop("_k").join(long, key, "left_semi")
    edge = kept_head.groupBy(*key).agg(F.max("turn").alias("head_turn")).join(kept_tail.groupBy(*key).agg(F.min("turn").alias("tail_turn")), key)
    states = turns.where((c("role") == "assistant") & c("text").contains("<")).select(*key, "turn", envelopes.block(c("text"), "state").alias("state")).where(c("state").isNotNull())
    placed = states.join(edge, key).where(c("turn") > c("head_turn"))
    middle = c("turn") < c("tail_turn")
    ledger = placed.groupBy(*key, "head_turn").agg(
        F.coalesce(F.max_by("state", F.when(middle, c("turn"))), F.max_by("state", F.when(~middle, c("turn")))).alias("state")
    )
    synthetic = ledger.select(*key, c("head_turn").alias("turn"), F.lit("assistant").alias("role"), F.format_string(LEDGER, "state").alias("text"), F.lit(1).alias("part"))
    part = lambda df, n: df.select(*key, "turn", "role", "text", F.lit(n).alias("part"))
    return part(short, 0).unionByName(part(kept_head, 0)).unionByName(synthetic).unionByName(part(kept_tail, 2))

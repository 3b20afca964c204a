"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions alone.

Logs of a chat are often saved again after each exchange. Every turn gets a
rolling hash of the conversation so far; a conversation whose last hash is some
other, longer one's hash at the same turn is a prefix of it and goes (anti-join),
and of equal ones the smallest conv_id stays. What is left is rendered.

Hashes of turns are combined by xor of position-dependent hashes, first within
blocks of BLOCK turns and then over blocks, so a conversation with very many
turns isn't one task's work. Two of 64 bits make 128.

Defined cases: repeated rows (same conv_id, turn, role and text) count once; turns
with the same number are ordered by role and text; null roles and texts are
empty; rows without conv_id or turn are left out; other columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from focusloom.llm.common import materialize

BLOCK = 256
#: Chat markup: how a turn is written.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with nulls filled."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.where("conv_id is not null and turn is not null").distinct()


def rolling_hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2): of the conversation up to each turn; pos counts from 1."""
    block = F.floor(F.col("turn") / BLOCK)
    named = rows.select("conv_id", block.alias("block"), "turn", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("2"), "text", "role").alias("t2"), "role", "text")
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    sizes = named.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("conv_id").orderBy("block")
    starts = sizes.select("conv_id", "block", (F.sum("n").over(over) - F.col("n")).alias("before"))
    placed = named.withColumn("k", F.count(F.lit(1)).over(inside)).join(starts, ["conv_id", "block"]).withColumn("pos", F.col("before") + F.col("k"))
    hashed = placed.select("conv_id", "block", "pos", F.xxhash64("pos", "t1").alias("a1"), F.xxhash64("t2", "pos").alias("a2"))
    here = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blocks = hashed.groupBy("conv_id", "block").agg(F.bit_xor("a1").alias("x1"), F.bit_xor("a2").alias("x2"))
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    earlier = blocks.select("conv_id", "block", F.coalesce(F.bit_xor("x1").over(past), F.lit(0)).alias("x1"), F.coalesce(F.bit_xor("x2").over(past), F.lit(0)).alias("x2"))
    inner = hashed.select("conv_id", "block", "pos", F.bit_xor("a1").over(here).alias("y1"), F.bit_xor("a2").over(here).alias("y2"))
    return inner.join(earlier, ["conv_id", "block"]).select("conv_id", "pos", F.col("x1").bitwiseXOR(F.col("y1")).alias("h1"), F.col("x2").bitwiseXOR(F.col("y2")).alias("h2"))


def maximal(rows: DataFrame) -> DataFrame:
    """conv_ids of conversations that no longer one begins with; of equal ones the smallest."""
    hashes = materialize(rolling_hashes(rows), "turns")
    last = hashes.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("l")).select("conv_id", "l.pos", "l.h1", "l.h2")
    single = last.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    # a proper prefix: some conversation has these hashes at a turn that isn't its last
    inner = hashes.join(last.select("conv_id", F.col("pos").alias("n")), "conv_id").where("pos < n").select("pos", "h1", "h2").distinct()
    return single.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_chars, rendered) of the maximal conversations."""
    rows = turns(conversations)
    kept = rows.join(maximal(rows), "conv_id", "left_semi")
    listed = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(f"{CLOSE}\n"))), "")
    return listed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("rendered")).select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), "rendered")

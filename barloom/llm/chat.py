"""Chat formatting: logged snapshots of a conversation collapse into the longest one before rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, discard

#: Turns of a conversation that one task sorts and renders together; longer conversations come in several parts.
BLOCK = 512


def _after(totals: DataFrame, sums: dict) -> DataFrame:
    """conv_id, block and for each name of sums the total (by its function) over the conversation's earlier blocks."""
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("conv_id", "block", *(F.coalesce(f(c).over(earlier), F.lit(0)).alias(c) for c, f in sums.items()))


def prefix_hashes(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """What `_prefix_hashes` has, without its table."""
    return _prefix_hashes(conversations, block)[0]


def _prefix_hashes(conversations: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(hashes, the table that they are read from); hashes: conv_id, turn, n, h1, h2: after each turn, the number of rows so far and a rolling 128-bit hash of them.

    The hash is the xor of one hash per turn over its place among the conversation's turns and its rows' roles and texts, so
    it doesn't matter whether turns count from 0 or 1 or leave gaps. Places and hashes roll within blocks of `block` turn
    numbers and the blocks' totals over the conversation: no task needs a whole conversation. Rows without conv_id take
    no part; exact repeats of a row count once; null turn counts as -1, null role and text as empty.
    """
    turn, role, text = F.coalesce("turn", F.lit(-1)), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select("conv_id", turn.alias("turn"), F.xxhash64(role, text, F.lit(1)).alias("a"), F.xxhash64(role, text, F.lit(2)).alias("b"))
    turns = rows.distinct().groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    # A table of its own: counts and hashes of blocks and what rolls over them are all read from it.
    turns = table = cut(turns.withColumn("block", F.floor(F.col("turn") / block)), "turns")
    within = W.partitionBy("conv_id", "block").orderBy("turn")
    turns = turns.withColumn("nth", F.row_number().over(within))
    before = _after(turns.groupBy("conv_id", "block").agg(F.count("*").alias("places")), {"places": F.sum})
    place = F.col("places") + F.col("nth")
    turns = turns.join(before, ["conv_id", "block"]).select("conv_id", "block", "turn", "n", *(F.xxhash64(place, "n", c).alias(c) for c in "ab"))
    totals = turns.groupBy("conv_id", "block").agg(F.sum("n").alias("n0"), F.bit_xor("a").alias("a0"), F.bit_xor("b").alias("b0"))
    offsets = _after(totals, {"n0": F.sum, "a0": F.bit_xor, "b0": F.bit_xor})
    so_far = within.rowsBetween(W.unboundedPreceding, 0)
    rolled = turns.select(
        "conv_id", "block", "turn", F.sum("n").over(so_far).alias("n"), F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b")
    )
    hashes = rolled.join(offsets, ["conv_id", "block"]).select(
        "conv_id", "turn", (F.col("n") + F.col("n0")).alias("n"), F.col("a").bitwiseXOR(F.col("a0")).alias("h1"), F.col("b").bitwiseXOR(F.col("b0")).alias("h2")
    )
    return hashes, table


def maximal(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no longer one begins with.

    Conversations equal in every turn are one; the smallest conv_id stands for all n_copies of them. No rows: none.
    """
    hashes, turns = _prefix_hashes(conversations, block)
    prefixes = cut(hashes, "prefixes")
    discard(turns)
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("n", "h1", "h2")).alias("end")).select("conv_id", "end.*")
    key = ["n", "h1", "h2"]
    whole = ends.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # A prefix is proper where more conversations pass through it than end at it.
    passes = prefixes.groupBy(*key).agg(F.count("*").alias("passing"))
    proper = passes.join(whole.select(*key, F.col("n_copies").alias("ending")), key, "left").where("passing > coalesce(ending, 0)")
    kept = cut(whole.join(proper, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies"), "kept-conversations")
    discard(prefixes)
    return kept


def render(conversations: DataFrame, kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, part, n_turns, n_copies, rendered: `<|role|>`, newline, text, `<|end|>`, newline for each turn in order.

    Turns with one number come in the order of role and text; exact repeats of a row are dropped before any rows meet. A
    part holds the distinct rows of one block of turn numbers.
    """
    rows = conversations.where("conv_id is not null").select(
        "conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.distinct().join(kept, "conv_id").withColumn("part", F.floor(F.col("turn") / block))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    parts = rows.groupBy("conv_id", "part").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), turns.alias("turns"))
    line = F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n")))
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join(line, "").alias("rendered"))


def format_chats(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The maximal conversations, rendered."""
    return render(conversations, maximal(conversations, block), block)

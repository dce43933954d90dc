"""Mixing sources to target weights: repetition rates per source, then whole and hash-seeded copies of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, every, fresh

#: Sources, in order, weigh these in turn.
WEIGHTS = (5, 2, 1)
#: The mix has this share of all words; no source is repeated more often than CAP times.
SHARE, CAP = 1.5, 2
#: Up to so many sources, their table is broadcast (some 100 bytes a row); beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target, rate: one row per source (null is a source of its own, the last).

    Targets fill up by weight until they reach cap * size; a source that is full leaves its excess to the others. With
    the sources ordered by cap / weight, the full ones come first, so one running sum finds the level of the rest. The
    table has a row per source, not per document, so its one global order is small. No words: every target is 0.
    """
    sizes = documents.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    table = cut(sizes, "source-sizes").select("source", "source_size", weight.alias("weight"), F.row_number().over(order).alias("nth"))
    table = table.withColumn("most", (F.col("source_size") * cap).cast("double"))
    filling = W.orderBy(F.col("most") / F.col("weight"), "nth")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    everything = filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    table = table.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    open_level = F.when(F.col("most") >= F.col("weight") * F.col("level"), F.col("level"))
    table = table.withColumn("level", F.first(open_level, ignorenulls=True).over(everything))
    target = F.coalesce(F.least("most", F.col("weight") * F.col("level")), F.col("most"))
    table = table.select("source", "source_size", target.alias("target"))
    return table.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def coin(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of doc_id and seed: the same on every run and engine."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _mixed(documents: DataFrame, targets: DataFrame, seed: int) -> tuple[DataFrame, str]:
    """documents with one more column, a struct of source_size, target and copies, and that column's name."""
    targets = cut(targets, "targets")
    of, found, mixed = (fresh(documents, name) for name in ("of", "source", "mix"))
    right = targets.select(F.col("source").alias(of), F.struct("source_size", "target", "rate").alias(found))
    if targets.count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    joined = documents.join(right, documents["source"].eqNullSafe(F.col(of)))
    rate = F.col(found)["rate"]
    copies = F.floor(rate) + (coin(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    struct = F.struct(F.col(found)["source_size"].alias("source_size"), F.col(found)["target"].alias("target"), copies.alias("copies"))
    return joined.select(*every(documents), struct.alias(mixed)), mixed


def with_copies(documents: DataFrame, targets: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """documents with source_size, target and copies: floor(rate), and one more with probability rate - floor(rate).

    Null text has size 0; rows that repeat a doc_id share its coin. Columns of documents that are called like those
    added here are replaced. Rows with a null source take the targets of the source null.
    """
    documents = documents.drop("source_size", "target", "copies")
    rows, mixed = _mixed(documents, source_targets(documents) if targets is None else targets, seed)
    return rows.select(*every(documents), f"{mixed}.*")


def mix(documents: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: each document as often as with_copies says, columns as before, whatever their names.

    A source without words has rate 0, so its documents go. No rows: none.
    """
    rows, mixed = _mixed(documents, source_targets(documents), seed)
    each = F.explode(F.sequence(F.lit(1), F.col(mixed)["copies"].cast("int"))).alias(fresh(documents, "copy"))
    return rows.where(F.col(mixed)["copies"] > 0).select(*every(documents), each).select(*every(documents))

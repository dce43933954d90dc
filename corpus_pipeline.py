"""From raw documents to token ids: the stages of a corpus pipeline, each an operator over all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bpe, common, langid, mixing, simhash, substring
from barloom.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents, and nothing else that docs may have."""
    common.small_batches(spark)
    return docs.select(COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter, or that no language's model predicts, go.

    Null and empty texts have no letter. Rows that repeat are judged alike and stay as many as they are; equal code lengths
    go to the first language by name. No labelled rows, or no rows: nothing is learned and nothing stays.
    """
    return langid.keep_identified(_rows(spark, docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id.

    Of rows that share it, the first by a hash of the text stays. Null, empty and wordless texts have fingerprint zero and
    are one group. Rows without doc_id never stand for a group: they go where a row with one is near, else all stay.
    """
    return simhash.keep_one(_rows(spark, docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or the same one, has already; n_chars follows.

    Null texts stay null. Rows that repeat a doc_id with one text are one document; with several, each text is one, in
    the order of a hash. Rows without doc_id lose nothing and count for nothing. No rows: none.
    """
    return substring.remove_repeats(_rows(spark, docs)).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for.

    A null source is one of its own. Null and empty texts have size 0. Rows that repeat a doc_id share its coin. A source
    without words has target and rate 0, so its documents go. No rows: none.
    """
    return mixing.mix(_rows(spark, docs))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the text that the ids decode to, a row for each row.

    Null text counts as empty: no ids, and an empty text.
    """
    path = tokenizer_file("byte_bpe_50k.json")
    encoded = bpe.encode(_rows(spark, docs).drop("n_chars"), path, decoded=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("bpe_tokens", bpe_tokens),
]

#: Fingerprints, byte contexts and merges have no form in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on documents; what each keeps is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = common.cut(stage(spark, docs, sf_dir), name)
        common.discard(docs)  # what a stage has read; the given table isn't ours to delete and stays
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

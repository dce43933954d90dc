"""Quality rules: heuristics on words and lines, and the log-likelihood ratio of hashed n-grams.

Words and pairs of words are hashed into BUCKETS. Two multinomials over the buckets, one of trusted documents and one of
the whole corpus, give each bucket a log ratio; a document's score is the mean over its n-grams. Everything is built-in
DataFrame functions on one pass to count and one to score; only the BUCKETS sums reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

BUCKETS, SMOOTHING = 10_000, 0.5
#: About so many trusted documents are taken, by a hash of doc_id; their ids (16 bytes each) are broadcast.
TRUSTED = 50_000
#: The least score, in nats per n-gram, of a document that is kept.
LEAST_SCORE = -0.1
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5


def words_of(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES.decode()))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _next(hashes: Column, by: Column, step: int) -> Column:
    """Hashes of each element with the element of `by` that stands `step` further on."""
    n = F.greatest(F.size(by) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(by, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def with_hashes(documents: DataFrame) -> DataFrame:
    """documents with _words, _one (a hash of each word) and _two (of each two in a row)."""
    rows = documents.withColumn("_words", words_of(F.col("text")))
    rows = rows.withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w)))
    return rows.withColumn("_two", _next(F.col("_one"), F.col("_one"), 1))


def buckets(n: int = BUCKETS) -> Column:
    return F.transform(F.concat("_one", "_two"), lambda h: F.pmod(h, F.lit(n)).cast("int"))


def log_ratios(documents: DataFrame, labels: DataFrame, n: int = BUCKETS, trusted: int = TRUSTED) -> list[float]:
    """The log ratio of each bucket, trusted to corpus; 0 everywhere without trusted documents.

    Trusted: labelled quality 1 and not toxic. All rows of documents count for the corpus.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    share = min(1.0, trusted / max(1, good.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = good.where(draw < share).select(F.col("doc_id").alias("_trusted"))
    rows = documents.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_trusted"), "left")
    grams = with_hashes(rows).select(F.col("_trusted").isNotNull().cast("long").alias("t"), F.explode(buckets(n)).alias("bucket"))
    counts = {r["bucket"]: (r["t"], r["n"]) for r in grams.groupBy("bucket").agg(F.sum("t").alias("t"), F.count("*").alias("n")).collect()}
    target, raw = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not target:
        return [0.0] * n
    ratio = lambda t, r: math.log((t + SMOOTHING) / (target + SMOOTHING * n)) - math.log((r + SMOOTHING) / (raw + SMOOTHING * n))
    return [ratio(*counts.get(b, (0, 0))) for b in range(n)]


def _repeated_words(size: int = WINDOW) -> tuple[dict[str, Column], ...]:
    """Columns, step by step, from _five (hashes of windows of `size` words) to n_repeat_words."""
    five, order, places = F.col("_five"), F.col("_order"), F.col("_places")
    some = F.size(F.array_distinct(five)) < F.size(five)
    pairs = F.sort_array(F.transform(five, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    n = F.greatest(F.size(order) - 1, F.lit(0))
    # Neighbours with one hash: both places count.
    equal = F.zip_with(F.slice(order, F.lit(1), n), F.slice(order, F.lit(2), n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    m = F.greatest(F.size(places) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(places, F.lit(1), m), F.slice(places, F.lit(2), m), lambda a, b: F.least(b - a, F.lit(size)))
    covered = F.when(F.size(places) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(size).cast("long"), lambda a, g: a + g))
    return (
        {"_order": F.when(some, pairs).otherwise(nothing)},
        {"_places": F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))},
        {"n_repeat_words": covered},
    )


def score(documents: DataFrame, ratios: list[float], least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr_score, kept.

    Every row gets a verdict. Null text has no words and fails; llr_score is null without words. Equal hashes of two
    windows (64 bits) count as equal windows. Columns of documents besides doc_id and text take no part.
    """
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES.decode()))) > 0)
    rows = with_hashes(documents.select("doc_id", "text"))
    rows = rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        _next(_next(F.col("_two"), F.col("_two"), 2), F.col("_one"), 4).alias("_five"),
        F.aggregate(buckets(len(ratios)), F.lit(0.0), lambda a, b: a + F.get(table, b)).alias("_sum"),
        (F.size("_one") + F.size("_two")).alias("_n"),
    )
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    for step in _repeated_words():
        rows = rows.withColumns(step)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    mean = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("llr_score") >= least, F.lit(False))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*columns, failed.alias("base_failed"), mean.alias("llr_score")).withColumn("kept", kept)


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """score with the ratios of documents and labels."""
    return score(documents, log_ratios(documents, labels))

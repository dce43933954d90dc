"""Substring dedup by seed and extend: winnowed anchors find where documents may repeat, their extensions decide.

Seeds: of every SPAN - SEED + 1 consecutive runs of SEED words, the run with the least hash is an anchor, so two equal
windows of SPAN words always share one. Anchors that occur once are dropped. Extension: each repeated anchor is extended
both ways to all windows of SPAN words that contain it, which join on their hashes (128 bits). The first of equal windows
is the partner of all others and stays, the others are repeats, and overlapping repeats join into maximal spans. An anchor
has many contexts, so its first occurrence alone can't be the partner; and windows are only ever counted or reduced to
their least member, so a passage that a third of all documents share costs one row per occurrence, not one per pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, columns_of, cut, discard, every, flat, fresh, map_batches, window_hashes, word_hashes, word_spans

#: Words in a window that counts as a repeat, and in a seed.
SPAN, SEED = 20, 6
#: Up to so many ids or positions (some 20 bytes each), a table of them is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Up to so many documents and spans together (some 50 bytes each), what is to be cut out of texts is broadcast.
BROADCAST_SPANS = 500_000
EMPTY = hashlib.sha256(b"").hexdigest()


def winnowed(words: np.ndarray, first: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, hash) of the anchors among the words of some documents; document r has words first[r] to first[r + 1]."""
    grams = window_hashes(words, seed)
    width = span - seed + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), grams[:0]
    ends = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(np.arange(len(grams) - width + 1) + span <= ends[: len(grams) - width + 1])
    if not len(starts):
        return np.zeros(0, np.int64), grams[:0]
    least = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    chosen = np.unique(starts + least[starts])
    return chosen, grams[chosen]


def _sketch(batches: Iterator[pa.RecordBatch], span: int, seed: int) -> Iterator[pa.RecordBatch]:
    """For each document: its number of words, their digest, two hashes of all of them, and its anchors."""
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        ids, texts = batch.column("doc_id"), batch.column("th")
        for i, j in blocks(offsets):
            text, starts, ends, first = word_spans(data, offsets[i : j + 1])
            words = word_hashes(text, starts, ends)
            at, hashes = winnowed(words, first, span, seed)
            owner = np.searchsorted(first, at, "right") - 1
            split = np.searchsorted(owner, np.arange(j - i + 1))
            digests = [hashlib.sha256(b" ".join(data[offsets[r] : offsets[r + 1]].tobytes().split())).digest() for r in range(i, j)]
            lists = pa.array(split, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    ids[i:j],
                    texts[i:j],
                    pa.array(np.diff(first)),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(lists, pa.array(hashes.view(np.int64))),
                    pa.ListArray.from_arrays(lists, pa.array((at - first[owner]).astype(np.int32))),
                ],
                names=["doc_id", "th", "n_words", "digest", "hashes", "positions"],
            )


def _candidates(n: int, marks: np.ndarray, span: int, seed: int) -> np.ndarray:
    """Where the windows begin that contain a marked anchor, in a document of n words."""
    open_at = np.zeros(n + 2, np.int64)
    np.add.at(open_at, np.maximum(marks - (span - seed), 0), 1)
    np.add.at(open_at, np.minimum(marks, n - span) + 1, -1)
    return np.flatnonzero(np.cumsum(open_at)[: n - span + 1] > 0)


def _windows(batches: Iterator[pa.RecordBatch], keys: list[str], span: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The windows around marked anchors: h and g, hashes of the window, and where it begins."""
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        ids, marks = [batch.column(k) for k in keys], batch.column("marks")
        for i, j in blocks(offsets):
            text, starts, ends, first = word_spans(data, offsets[i : j + 1])
            words = word_hashes(text, starts, ends)
            found = [first[r - i] + _candidates(int(first[r - i + 1] - first[r - i]), np.asarray(marks[r].as_py(), np.int64), span, seed) for r in range(i, j)]
            at = np.concatenate(found) if found else np.zeros(0, np.int64)
            owner = np.searchsorted(first, at, "right") - 1
            h, g = window_hashes(words, span)[at], window_hashes(words, span, 1)[at]
            owners = [c[i:j].take(pa.array(owner)) for c in ids]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), *owners, pa.array((at - first[owner]).astype(np.int32))], names=["h", "g", *keys, "pos"])


def removed_words(n: int, repeats: np.ndarray, span: int) -> np.ndarray:
    """True for each of n words that a window beginning in repeats covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, repeats, 1)
    np.add.at(edge, repeats + span, -1)
    return np.cumsum(edge)[:n] > 0


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of each run of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _settle(batches: Iterator[pa.RecordBatch], keys: list[str], span: int, seed: int) -> Iterator[pa.RecordBatch]:
    """From a document's marks and the windows of it that stay: what is removed."""
    for batch in batches:
        removed, spans = [], []
        for n, marks, stay in zip(*(batch.column(c).to_pylist() for c in ("n_words", "marks", "stay")), strict=True):
            repeats = np.setdiff1d(_candidates(n, np.asarray(marks, np.int64), span, seed), np.asarray(stay or [], np.int64))
            gone = runs(removed_words(n, repeats, span))
            removed.append(sum(b - a for a, b in gone))
            spans.append([{"start": a, "end": b} for a, b in gone])
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(removed, pa.int64()), pa.array(spans, _SPANS)], names=[*keys, "n_removed", "spans"])


def _kept(text: bytes, spans: list[dict]) -> bytes:
    words = text.split()
    keep = np.ones(len(words), bool)
    for s in spans:
        keep[s["start"] : s["end"]] = False
    return b" ".join(compress(words, keep))


def _digest(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = flat(batch.column("text"))
        found = [hashlib.sha256(_kept(data[at[r] : at[r + 1]].tobytes(), spans)).digest() for r, spans in enumerate(batch.column("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("n_removed"), pa.array(found, pa.binary()), batch.column("spans")], names=[*keys, "n_removed", "kept", "spans"])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SPANS_SQL = "spans array<struct<start:int,end:int>>"


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows are within BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(F.col("text")).alias("th"), "text")


def _longs(keys: list[str]) -> str:
    return ", ".join(f"{k} long" for k in keys)


def _found(documents: DataFrame, span: int, seed: int) -> tuple[list[str], DataFrame, DataFrame, DataFrame, DataFrame]:
    """What names a document, each one's text, a sketch of each, n_words of later copies of whole documents, n_removed and spans of others.

    doc_id names a document; where rows of one doc_id have different texts, doc_id and a hash of the text do.
    """
    texts = _texts(documents)
    sketches = cut(map_batches(texts, lambda x: _sketch(x, span, seed), "doc_id long, th long, n_words long, digest binary, hashes array<long>, positions array<int>"), "sketches")
    named = sketches.where(F.col("doc_id").isNotNull())
    keys = ["doc_id"] if named.groupBy("doc_id").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").isEmpty() else ["doc_id", "th"]

    texts = texts.select(*keys, "text")  # one form for all joins, so that they share an exchange

    long_ones = named.where(F.col("n_words") >= span).select(*keys, "n_words", "digest")
    firsts = cut(long_ones.groupBy("digest").agg(F.min(F.struct(*keys)).alias("first"), F.count("*").alias("n")).where("n > 1"), "copied")
    copies = cut(long_ones.join(firsts, "digest").where(F.struct(*keys) > F.col("first")).select(*keys, "n_words").distinct(), "copies")

    anchored = named.join(_small(copies.select(*keys)), keys, "left_anti")
    anchors = anchored.select(*keys, F.explode(F.arrays_zip("hashes", "positions")).alias("a")).select(*keys, F.col("a.hashes").alias("h"), F.col("a.positions").alias("pos"))
    # A table of its own, so that the join below may split the anchors of a frequent hash.
    repeated = cut(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-anchors")
    marks = cut(anchors.join(repeated, "h").groupBy(*keys).agg(F.collect_set("pos").alias("marks")), "marks")
    discard(firsts, repeated)

    windows = map_batches(texts.join(marks, keys), lambda x: _windows(x, keys, span, seed), f"h long, g long, {_longs(keys)}, pos int")
    stay = windows.groupBy("h", "g").agg(F.min(F.struct(*keys, "pos")).alias("first")).select("first.*").groupBy(*keys).agg(F.collect_list("pos").alias("stay"))
    sizes = named.select(*keys, "n_words").dropDuplicates(keys)
    settled = map_batches(marks.join(sizes, keys).join(stay, keys, "left"), lambda x: _settle(x, keys, span, seed), f"{_longs(keys)}, n_removed long, {_SPANS_SQL}")
    return keys, texts, sketches, copies, settled.where("n_removed > 0")


def repeats(documents: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans: the words that windows found earlier cover, as maximal runs.

    Earlier: in a document of smaller doc_id, or further ahead in the same one. Null text has no words. Rows that repeat
    a doc_id with one text are one document; with several texts, each text is a document, in the order of a hash. Rows
    without doc_id lose nothing and count for nothing. Other columns take no part. No rows: none.
    """
    keys, texts, sketches, copies, settled = _found(documents, span, seed)
    digests = map_batches(texts.join(settled, keys), lambda x: _digest(x, keys), f"{_longs(keys)}, n_removed long, kept binary, {_SPANS_SQL}")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    gone = copies.select(*keys, F.col("n_words").alias("n_removed"), F.unhex(F.lit(EMPTY)).alias("kept"), whole.alias("spans"))
    changed = digests.dropDuplicates(keys).unionByName(gone)
    return sketches.select("doc_id", "th", "n_words", "digest").join(changed, keys, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.lower(F.hex(F.coalesce("kept", "digest"))).alias("kept_sha256"), "spans"
    )


def _without(batches: Iterator[pa.RecordBatch], cuts: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column("text").to_pylist(), batch.column(cuts).to_pylist()
        for r, gone in enumerate(spans):
            if gone:
                texts[r] = _kept((texts[r] or "").encode(), gone).decode()
        k = batch.schema.get_field_index("text")
        yield batch.set_column(k, "text", pa.array(texts, batch.schema.field(k).type)).drop_columns([cuts])


def remove_repeats(documents: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """documents with the repeats taken out of text; what is kept has one space between words. Other texts stay as they are.

    Null text stays null; which rows are one document, and which lose nothing, is as in `repeats`.
    """
    rows = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    keys, _, sketches, copies, settled = _found(documents, span, seed)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    changed = cut(settled.select(*keys, "spans").unionByName(copies.select(*keys, whole.alias("spans"))), "spans")
    discard(sketches, copies)
    cuts = fresh(documents, "spans")
    n = changed.agg(F.sum(F.size("spans") + 1)).first()[0] or 0
    names = {k: fresh(documents, f"of_{k}") for k in keys}
    right = changed.select(*(F.col(k).alias(names[k]) for k in keys), F.col("spans").alias(cuts))
    same = rows["doc_id"] == F.col(names["doc_id"])
    if "th" in keys:
        same = same & (_text_hash(rows["text"]) == F.col(names["th"]))
    joined = rows.join(F.broadcast(right) if n <= BROADCAST_SPANS else right, same, "left").select(*every(documents), cuts)
    return map_batches(joined, lambda x: _without(x, cuts), columns_of(rows))

"""Language ID by prediction by partial matching over bytes.

Each language has a tree of contexts of up to ORDER bytes with the counts of the bytes that followed. A byte is coded in
the longest context that the language knows; bytes it has not seen there escape (method C: a context with d kinds among
n followers escapes with d / (n + d)) to the next shorter context, without those already excluded, and at last to 256
equal chances. The counts are frozen after training, so a text's code length is the sum of fixed costs, one for each
byte and the ORDER bytes before it. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, every, flat, fresh, map_batches

ORDER = 3
#: Training takes about so many labelled documents of each language by a hash of doc_id, of a longer one a piece of so
#: many characters from a place by another hash; these bounds hold whatever the size of the table.
SAMPLE, SAMPLE_CHARS = 400, 20_000
#: Languages whose costs stand side by side in one table.
TOGETHER = 8
#: What stands before the first byte of a text.
PAD = 0x0A
UNKNOWN = "und"
_STEP = 1 << 17


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: how often each run of ORDER + 1 bytes occurs, as a number, by language."""
    counts: dict[tuple[str, int], int] = {}
    for batch in batches:
        data, at = flat(batch.column("text"))
        for r, lang in enumerate(batch.column("lang").to_pylist()):
            b = np.concatenate((np.full(ORDER, PAD, np.uint8), data[at[r] : at[r + 1]])).astype(np.int64)
            gram = np.zeros(len(b) - ORDER, np.int64)
            for k in range(ORDER + 1):
                gram = gram << 8 | b[k : k + len(gram)]
            for g, n in zip(*(x.tolist() for x in np.unique(gram, return_counts=True)), strict=True):
                counts[lang, g] = counts.get((lang, g), 0) + n
    if counts:
        langs, grams = zip(*counts, strict=True)
        yield pa.RecordBatch.from_pydict({"lang": list(langs), "gram": list(grams), "n": list(counts.values())})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(documents: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """lang, text of about `sample` documents a language, chosen by a hash of doc_id among those with a letter that are not held out."""
    rows = documents.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    # A row for each language: as many as the model has tables for.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows.select("lang", "text")
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n)))), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    n = F.length("text")
    piece = F.when(n > chars, F.substr("text", (F.pmod(F.xxhash64("doc_id", F.lit(29)), n - chars + 1) + 1).cast("int"), F.lit(chars))).otherwise(F.col("text"))
    return rows.where(draw < share).select("lang", piece.alias("text"))


class Lookup:
    """Where each of some distinct unsigned keys stands among them, by a hash table that is a quarter full."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(keys), dtype=np.int32), self._slot(self.keys)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            left = self.slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys (unsigned 64-bit); -1 where there is none."""
        slot = self._slot(keys)
        at = self.slots[slot]
        wrong = np.flatnonzero((at >= 0) & (self.keys[at] != keys)) if len(self.keys) else at[:0]
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
            at[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(at[wrong] >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return at


class Level:
    """Contexts of k bytes: the bits of the bytes that some language saw after them, and of an escape from them."""

    def __init__(self, seen: Lookup, bits: np.ndarray, contexts: Lookup, escape: np.ndarray):
        self.seen, self.bits, self.contexts, self.escape = seen, bits, contexts, escape


class Model:
    """Costs in bits by context and byte for each language; see the module's text.

    A byte that no language of a table saw in a context costs the escape there and what it costs in the next shorter one,
    so only what training saw is kept, whole.
    """

    def __init__(self, langs: np.ndarray, grams: np.ndarray, n: np.ndarray):
        self.languages = sorted(set(langs.tolist()))
        number = {x: k for k, x in enumerate(self.languages)}
        lang = np.fromiter((number[x] for x in langs.tolist()), np.int64, len(langs))
        self.tables = []
        for first in range(0, len(self.languages), TOGETHER):
            own = (lang >= first) & (lang < first + TOGETHER)
            self.tables.append(self._table(lang[own] - first, grams[own].astype(np.uint64), n[own], min(TOGETHER, len(self.languages) - first)))

    @staticmethod
    def _table(lang: np.ndarray, grams: np.ndarray, n: np.ndarray, languages: int) -> list[Level]:
        levels: list[Level] = []
        for k in range(ORDER + 1):
            key = grams & np.uint64((1 << 8 * (k + 1)) - 1)
            keys, at = np.unique(key, return_inverse=True)
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            counts = np.zeros((len(keys), languages))
            np.add.at(counts, (at, lang), n)
            total, kinds, less = (np.zeros((len(contexts), languages)) for _ in range(3))
            np.add.at(total, of, counts)
            np.add.at(kinds, of, counts > 0)
            # What a byte costs in the next shorter context, which every language that knows this one knows.
            shorter = levels[-1].bits[levels[-1].seen.find(keys & np.uint64((1 << 8 * k) - 1))] if k else np.full(counts.shape, 8.0)
            np.add.at(less, of, np.where(counts > 0, np.exp2(-shorter), 0.0))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds) / np.maximum(1e-15, 1 - less)), 0.0)
                bits = np.where(counts > 0, -np.log2(counts / (total + kinds)[of]), escape[of] + shorter)
            levels.append(Level(Lookup(keys), bits, Lookup(contexts), escape))
        for level in levels:
            level.bits, level.escape = level.bits.astype(np.float32), level.escape.astype(np.float32)
        return levels

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The bits of each gram's last byte after the ORDER before it (rows), in each language (columns)."""
        return np.hstack([self._bits(levels, grams) for levels in self.tables]) if self.tables else np.zeros((len(grams), 1), np.float32)

    @staticmethod
    def _bits(levels: list[Level], grams: np.ndarray) -> np.ndarray:
        out = np.zeros((len(grams), levels[0].bits.shape[1]), np.float32)
        rows = None
        for k in range(ORDER, -1, -1):
            at = levels[k].seen.find(grams)
            if rows is None:
                out = levels[k].bits[np.maximum(at, 0)]
                rows = np.flatnonzero(at < 0)
                out[rows] = 0
            else:
                hit = at >= 0
                out[rows[hit]] += levels[k].bits[at[hit]]
                rows = rows[~hit]
            if not len(rows):
                return out
            grams = grams[at < 0]
            context = levels[k].contexts.find(grams >> np.uint64(8))
            known = context >= 0
            out[rows[known]] += levels[k].escape[context[known]]
            grams = grams & np.uint64((1 << 8 * k) - 1) if k else grams
        out[rows] += 8.0
        return out

    def code_lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits for each text (rows) in each language (columns); text r has bytes at[r] to at[r + 1] of data."""
        total = np.zeros((len(at) - 1, max(1, len(self.languages))))
        for a in range(int(at[0]), int(at[-1]), _STEP):
            b = min(int(at[-1]), a + _STEP)
            first = max(0, a - ORDER)
            before = data[first:b].astype(np.uint64)
            begins = at[(at >= first) & (at < b)] - first
            gram = before.copy()
            for k in range(1, ORDER + 1):
                before = np.concatenate((np.array([PAD], np.uint64), before[:-1]))
                before[begins] = PAD
                gram |= before << np.uint64(8 * k)
            cost = self.bits(gram[a - first :])
            run = np.concatenate((np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0, dtype=np.float64)))
            lo, hi = np.clip(at[:-1] - a, 0, b - a), np.clip(at[1:] - a, 0, b - a)
            total += run[hi] - run[lo]
        return total


def train(documents: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model from a bounded sample of documents that are not held out. Only the sample's byte counts reach the driver."""
    picked = training_sample(documents, sample, chars)
    counts = map_batches(picked, _grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    return Model(np.array(counts.column("lang").to_pylist(), object), counts.column("gram").to_numpy(), counts.column("n").to_numpy())


def _verdicts(m: Model, batch: pa.RecordBatch, letters: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: the language's number, or -1; its share; the bits a byte of its code."""
    data, at = flat(batch.column("text"))
    bits = m.code_lengths(data, at)
    best = bits.argmin(1)
    least = bits[np.arange(len(bits)), best]
    share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    ok = batch.column(letters).to_numpy(zero_copy_only=False).astype(bool) & (len(m.languages) > 0)
    return np.where(ok, best, -1), np.where(ok, share, 0.0), np.where(ok, least / np.maximum(1, np.diff(at)), np.nan)


def _letters() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for every document.

    lang_pred is `und`, with score 0, for texts that are null or without a letter, and where no language was learned.
    score is the winner's share of 2 to the minus code lengths. Equal code lengths: the first language by name. A null
    doc_id is not held out. Extra columns take no part; repeated rows each get a row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or train(documents))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for batch in batches:
            best, share, per_byte = _verdicts(shared.value, batch, "letters")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(share), pa.array(per_byte, mask=best < 0)],
                names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", _letters().alias("letters"))
    return map_batches(rows, score, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


#: A text that costs more bits a byte in its best language than this is in none of those learned.
REJECT_BITS = 5.5


def keep_identified(documents: DataFrame) -> DataFrame:
    """documents in a learned language: those with a letter whose best code takes at most REJECT_BITS a byte.

    Null and empty texts have no letter and go; rows that repeat are judged alike. Where nothing is learned, nothing stays.
    """
    shared, letters = documents.sparkSession.sparkContext.broadcast(train(documents)), fresh(documents, "letters")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, _, per_byte = _verdicts(shared.value, batch, letters)
            yield batch.drop_columns([letters]).filter(pa.array((best >= 0) & ~(per_byte > REJECT_BITS)))

    return map_batches(documents.select(*every(documents), _letters().alias(letters)), keep, columns_of(documents))

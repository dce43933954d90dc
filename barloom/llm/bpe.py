"""Byte-level BPE encoding and decoding.

Words (pre-tokens) of up to SHORT bytes are merged many at a time in contiguous rank arrays: a row holds the parts between
a word's boundaries, another the rank of each two neighbours. The least rank of each row is found by a scan, its boundary
is deleted by shifting the row, and the ranks on both sides of the new part are looked up again, until no neighbours
can merge. Longer words go through a heap. Each distinct stretch of text is encoded once per task and then looked up.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, columns_of, flat, map_batches, quoted

#: Fixed value: the pattern that cuts a text into words before merging.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A stretch of text whose words don't depend on what stands around it.
STRETCH = regex.compile(r"\s*\S+|\s+")
SHORT = 32
#: Stretches and words that a task remembers before it starts anew.
REMEMBER = 400_000
_NONE = np.iinfo(np.int32).max


def letters_of_bytes() -> dict[int, str]:
    """The letter that stands for each byte in vocabulary files: itself where it prints, else the next free one from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Bytes of each id, ids of single bytes, and for each pair of ids that merges its rank and the id it makes."""

    def __init__(self, text: str):
        data = json.loads(text)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        byte_of = {c: b for b, c in letters_of_bytes().items()}
        ids = data["model"]["vocab"]
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, k in ids.items():
            self.bytes[k] = bytes(byte_of[c] for c in token) if token not in self.special else token.encode()
        for token, k in self.special.items():
            self.bytes[k] = token.encode()
        suffix = data["model"].get("end_of_word_suffix") or ""
        letters = [c for _, c in sorted(letters_of_bytes().items())]
        self.of_byte, self.of_last = (np.array([ids.get(c + end, -1) for c in letters], np.int32) for end in ("", suffix))
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each)."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        short = order[sizes[order] <= SHORT]
        parts: list[np.ndarray] = [np.zeros(0, np.int32)]
        counts = np.zeros(len(words), np.int64)
        for a in range(0, len(short), 4096):
            rows = short[a : a + 4096]
            ids, counts[rows] = self._short(b"".join([words[k] for k in rows.tolist()]), sizes[rows])
            parts.append(ids)
        for k in order[len(short) :].tolist():
            parts.append(self._long(words[k]))
            counts[k] = len(parts[-1])
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return gathered(np.concatenate(parts), starts, counts), counts

    def _short(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(sizes[-1])
        columns = np.arange(width)
        parts = np.zeros((len(sizes), width), np.int32)
        raw = np.frombuffer(data, np.uint8)
        parts[columns < sizes[:, None]] = self.of_byte[raw]
        parts[np.arange(len(sizes)), sizes - 1] = self.of_last[raw[np.cumsum(sizes) - 1]]
        ranks = np.full((len(sizes), width), _NONE, np.int32)
        pairs = columns[1:] < sizes[:, None]
        ranks[:, :-1][pairs] = self.rank(parts[:, :-1][pairs], parts[:, 1:][pairs])
        n, live = sizes.copy(), np.arange(len(sizes))
        while len(live):
            row = np.arange(len(live))
            p, r = parts[live], ranks[live]
            at = r.argmin(axis=1)
            least = r[row, at]
            go = least < _NONE
            if not go.all():
                live, p, r, at, least = live[go], p[go], r[go], at[go], least[go]
                row = row[: len(live)]
            if not len(live):
                break
            shift = np.minimum(columns + (columns > at[:, None]), width - 1)
            p = np.take_along_axis(p, shift, axis=1)
            p[row, at] = self.made[least]
            r = np.take_along_axis(r, np.minimum(columns + (columns >= at[:, None]), width - 1), axis=1)
            r[:, -1] = _NONE
            n[live] -= 1
            after = at + 1 < n[live]
            r[row, at] = _NONE
            r[row[after], at[after]] = self.rank(p[row[after], at[after]], p[row[after], at[after] + 1])
            before = at > 0
            r[row[before], at[before] - 1] = self.rank(p[row[before], at[before] - 1], p[row[before], at[before]])
            parts[live], ranks[live] = p, r
        return parts[columns < n[:, None]], n

    def _long(self, word: bytes) -> np.ndarray:
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, ids[-1] = len(ids), int(self.of_last[word[-1]])
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        first = self.rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(first) if r < _NONE]
        heapq.heapify(heap)
        if not hasattr(self, "_ranks"):
            self._ranks = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        while heap:
            r, k, a, b = heapq.heappop(heap)
            m = right[k]
            if ids[k] != a or m >= n or ids[m] != b:
                continue
            ids[k], ids[m] = int(self.made[r]), -1
            right[k] = right[m]
            if right[m] < n:
                left[right[m]] = k
            for i, j in ((left[k], k), (k, right[k])):
                if i >= 0 and j < n and (q := self._ranks.get(ids[i] << 32 | ids[j])) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[j]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after another."""
        return gathered(self.joined, self.starts[ids], self.sizes[ids])


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of data that begin at starts, one after another."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Pool:
    """Sequences of ids by key, in one growing array."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.data, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, first = self.used + len(ids), len(self.at)
        while len(self.data) < n:
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        while len(self.starts) < first + len(keys):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
        self.data[self.used : n] = ids
        self.sizes[first : first + len(keys)] = sizes
        self.starts[first : first + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.at.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.used = n

    def index(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))

    def get(self, index: np.ndarray) -> np.ndarray:
        return gathered(self.data, self.starts[index], self.sizes[index])


def checked(text: str) -> str:
    """text, a vocabulary file, if it is of the kind that Encoder encodes like the tokenizers library, else ValueError.

    That is: byte-level BPE without a normaliser, cut by the pattern WORDS without a blank put in front, no end-of-word
    marks, no unknown token, dropout or whole-word shortcut, and special tokens that are found anywhere as they are.
    """
    data = json.loads(text)
    model, cut = data["model"], data.get("pre_tokenizer") or {}
    wrong = [
        name
        for name, bad in {
            "normalizer": data.get("normalizer"),
            "pre_tokenizer": cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True),
            "decoder": (data.get("decoder") or {}).get("type") != "ByteLevel",
            "model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
            "added_tokens": any(t.get(k) for t in data["added_tokens"] for k in ("lstrip", "rstrip", "single_word")) or any(t["normalized"] and not t["special"] and data.get("normalizer") for t in data["added_tokens"]),
        }.items()
        if bad
    ]
    if wrong:
        raise ValueError(f"a vocabulary file of another kind: {', '.join(wrong)}")
    return text


class Encoder:
    """Encodes texts, remembering what it has seen. Special tokens in a text get their own ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.firsts = "".join(sorted({x[0] for x in vocabulary.special}))
        self._forget()

    def _forget(self) -> None:
        self.words, self.plain, self.exact = Pool(), Pool(), Pool()
        self.unsafe: set[int] = set()
        if self.vocabulary.special:
            names = list(self.vocabulary.special)
            self.exact.add(names, np.array([self.vocabulary.special[x] for x in names], np.int32), np.ones(len(names), np.int64))

    def _learn(self, pool: Pool, keys: list[str], stretches: list[str]) -> None:
        words = [WORDS.findall(s) for s in stretches]
        new = list({w for ws in words for w in ws}.difference(self.words.at))
        self.words.add(new, *self.vocabulary.merged([w.encode() for w in new]))
        index = self.words.index([w for ws in words for w in ws])
        ends = np.cumsum([len(ws) for ws in words])
        total = np.concatenate(([0], np.cumsum(self.words.sizes[index])))
        pool.add(keys, self.words.get(index), total[ends] - total[np.concatenate(([0], ends[:-1]))] if len(ends) else ends)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each).

        A text is cut before every space and newline; that is where words may be cut too, except in white space of three
        or more characters. Stretches that could stand in such a run are unsafe, and their texts are cut at STRETCH.
        """
        if len(self.plain.at) + len(self.exact.at) + len(self.words.at) > REMEMBER:
            self._forget()
        cut: list[list[str]] = []
        odd: set[int] = set()
        for k, text in enumerate(texts):
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = " " + pieces[0]
            cut.append(pieces)
            if any(c in text for c in self.firsts) and self.special.search(text):
                odd.add(k)
                cut[k] = []
        keys = [x for pieces in cut for x in pieces]
        new = list(set(keys).difference(self.plain.at))
        if new:
            stretches = [x[1:] if x[:1] == " " else x if x[:1] == "\n" else " " + x for x in new]
            first = len(self.plain.at)
            self._learn(self.plain, new, stretches)
            for j, (x, s) in enumerate(zip(new, stretches, strict=True)):
                rest = s if x[:1] == " " else s[1:]
                if (rest == "" and x != " ") or (rest != "" and (rest[-1].isspace() or (rest[0].isspace() and x[:1] != " "))):
                    self.unsafe.add(first + j)
        index = self.plain.index(keys)
        counts = np.array([len(c) for c in cut], np.int64)
        if self.unsafe and len(index):
            bad = np.isin(index, np.fromiter(self.unsafe, np.int64, len(self.unsafe)))
            owner = np.repeat(np.arange(len(cut)), counts)
            odd.update(np.unique(owner[bad]).tolist())
        if not odd:
            return self._joined(self.plain, index, counts)
        parts, n, at = [], np.zeros(len(texts), np.int64), np.cumsum(counts) - counts
        for k, text in enumerate(texts):
            if k in odd:
                ids = self._exactly(text)
            else:
                ids = self.plain.get(index[at[k] : at[k] + counts[k]])
            parts.append(ids)
            n[k] = len(ids)
        return np.concatenate(parts), n

    @staticmethod
    def _joined(pool: Pool, index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.concatenate(([0], np.cumsum(pool.sizes[index])))
        ends = np.cumsum(counts)
        return pool.get(index), total[ends] - total[ends - counts]

    def _exactly(self, text: str) -> np.ndarray:
        keys = []
        for k, piece in enumerate(self.special.split(text) if self.special is not None else [text]):
            keys += [piece] if k % 2 else STRETCH.findall(piece)
        new = list(set(keys).difference(self.exact.at))
        self._learn(self.exact, new, new)
        return self.exact.get(self.exact.index(keys))


@lru_cache(maxsize=1)
def encoder_of(text: str) -> Encoder:
    """The encoder that the tasks of one worker share, with what it remembers."""
    return Encoder(Vocabulary(checked(text)))


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))


def _texts(vocabulary: Vocabulary, ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """The texts that runs of n ids spell. Bytes that aren't UTF-8 become U+FFFD."""
    ids = ids.astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(vocabulary.sizes[ids])))[np.concatenate(([0], np.cumsum(n)))]
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(vocabulary.spelled(ids))])
    try:
        return spelled.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode(errors="replace") for x in spelled.to_pylist()], pa.string())


def encode(documents: DataFrame, tokenizer: str, decoded: bool = False) -> DataFrame:
    """documents with ids (array<int>) and n_tokens; tokenizer is the path of a byte-level vocabulary file (JSON).

    A file of another kind raises ValueError; see `checked`. Null text counts as empty and has no ids. Columns called ids or n_tokens are replaced; rows may repeat. With decoded,
    text becomes what the ids spell, in the same pass.
    """
    rows = documents.drop("ids", "n_tokens")
    shared = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            place = batch.schema.get_field_index("text")
            _, offsets = flat(batch.column(place))
            for i, j in blocks(offsets, 1 << 19):
                part = batch.slice(i, j - i)
                ids, n = encoder.encode([x or "" for x in part.column(place).to_pylist()])
                columns = part.columns
                if decoded:
                    columns[place] = _texts(encoder.vocabulary, ids, n)
                yield pa.RecordBatch.from_arrays([*columns, _lists(ids, n), pa.array(n)], names=[*batch.schema.names, "ids", "n_tokens"])

    return map_batches(rows, task, f"{columns_of(rows)}, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, tokenizer: str, to: str = "decoded") -> DataFrame:
    """encoded with column `to`: the text that column ids spells; null ids give null."""
    rows = encoded.drop(to)
    shared = encoded.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_of(shared.value).vocabulary
        for batch in batches:
            column = batch.column("ids")
            sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
            for i, j in blocks(np.concatenate(([0], np.cumsum(sizes))), 1 << 18):
                some = column[i:j]
                texts = _texts(vocabulary, np.asarray(some.flatten(), np.int64), sizes[i:j])
                if some.null_count:
                    texts = pa.array([t if ok else None for t, ok in zip(texts.to_pylist(), some.is_valid().to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, texts], names=[*batch.schema.names, to])

    return map_batches(rows, task, f"{columns_of(rows)}, {quoted(to)} string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids, in decimal with commas, and of the decoded text in column text."""
    return encoded.select(
        "doc_id", "n_tokens", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )

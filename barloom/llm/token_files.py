"""Token-id files: blocks of ids as byte planes, each compressed with zstandard, under a chunk index.

A file is: MAGIC; for each block of BLOCK ids (the last may be shorter) four planes, plane k holding byte k of every id
as unsigned 32-bit little-endian; two more planes with the documents' ids (signed 64-bit) and numbers of ids; the index;
and the index's length with MAGIC again. The index is JSON: blocks as [ids, [offset, bytes] of each plane], documents as
[how many, [offset, bytes] of their ids, [offset, bytes] of their sizes]. A reader gets any run of ids from the index
and the blocks that hold it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Pool, Vocabulary
from .common import blocks, cut, flat, map_batches, scratch, spread

MAGIC = b"IDPLANE1"
#: Ids in a block; ids after which a file is closed.
BLOCK, FILE_IDS = 1 << 16, 1 << 25
#: The id that ends every document.
END = 1
#: Words that a task remembers before it starts anew.
REMEMBER = 600_000


class Writer:
    """Writes documents' ids to a stream, block by block."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0
        self.blocks: list[list] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.packer = zstandard.ZstdCompressor(level=3)
        self._put(MAGIC)

    def _put(self, data: bytes) -> list[int]:
        self.stream.write(data)
        self.at += len(data)
        return [self.at - len(data), len(data)]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.held.append(np.asarray(ids, "<u4"))
        self.n, self.n_held = self.n + len(ids), self.n_held + len(ids)
        if self.n_held >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        whole = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for a in range(0, whole, BLOCK):
            some = ids[a : min(whole, a + BLOCK)]
            planes = np.ascontiguousarray(some.view(np.uint8).reshape(-1, 4).T)
            self.blocks.append([len(some), [self._put(self.packer.compress(p.tobytes())) for p in planes]])
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        null = [k for k, d in enumerate(self.docs) if d is None]
        ids = np.array([d or 0 for d in self.docs], "<i8")
        docs = [len(self.docs), *(self._put(self.packer.compress(x.tobytes())) for x in (ids, np.array(self.sizes, "<i8")))]
        index = json.dumps({"blocks": self.blocks, "documents": docs, "without_id": null}).encode()
        self._put(index)
        self._put(len(index).to_bytes(8, "little") + MAGIC)


def read_file(source) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, where it starts, ids) of each document of a file that can seek; holds a block and a document at a time."""

    def piece(offset: int, size: int) -> bytes:
        source.seek(offset)
        data = source.read(size)
        if len(data) != size:
            raise ValueError("the file ends early")
        return data

    source.seek(0, 2)
    end = source.tell()
    tail = piece(end - 16, 16)
    if tail[8:] != MAGIC or piece(0, 8) != MAGIC:
        raise ValueError("not a token-id file")
    size = int.from_bytes(tail[:8], "little")
    index = json.loads(piece(end - 16 - size, size))
    unpacker = zstandard.ZstdDecompressor()
    n, *planes = index["documents"]
    docs, sizes = (np.frombuffer(unpacker.decompress(piece(*p)), "<i8").tolist() if n else [] for p in planes)
    null = set(index["without_id"])

    def stored() -> Iterator[np.ndarray]:
        for n_ids, parts in index["blocks"]:
            planes = [np.frombuffer(unpacker.decompress(piece(*p)), np.uint8) for p in parts]
            yield np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").reshape(n_ids)

    source_blocks, held, at = stored(), np.zeros(0, "<u4"), 0
    for k, (doc_id, size) in enumerate(zip(docs, sizes, strict=True)):
        parts, got = [held], len(held)
        while got < size:
            parts.append(next(source_blocks))
            got += len(parts[-1])
        ids = np.concatenate(parts) if len(parts) > 1 else held
        held = ids[size:]
        yield None if k in null else doc_id, at, ids[:size]
        at += size


class LibraryEncoder:
    """Encodes texts as the tokenizers library does, each distinct word that a worker meets once.

    The tokenizer must drop white space and treat words apart, as word-level byte-pair encodings do; then a text's ids are
    those of the stretches between its spaces and newlines. With latin_merges, words of Latin letters, with a comma or full
    stop after them or not, need no more of it than lower case and merges, which are done many at a time; a tokenizer
    whose own vocabulary says otherwise is refused. All other words, and without latin_merges all, go through the library.
    """

    def __init__(self, text: str, latin_merges: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.pool = Pool()
        self.merges: Vocabulary | None = None
        if latin_merges:
            if not json.loads(text)["model"].get("end_of_word_suffix"):
                raise ValueError("latin_merges needs a vocabulary with a suffix at the end of words")
            self.merges = Vocabulary(text)
            self.marks = {c: self._by_library([c]) for c in ",."}
            tokens = [t.removesuffix("</w>") for t in sorted(self.library.get_vocab())]
            sample = [a.title() + b + c for a, b, c in zip(tokens[::23], tokens[7::23], ["", ",", "."] * len(tokens), strict=False) if self._stem(a.title() + b + c)]
            mine, theirs = self._by_merges(sample, [self._stem(w) for w in sample]), self._by_library(sample)
            if not sample or not all(np.array_equal(x, y) for x, y in zip(mine, theirs, strict=True)):
                raise ValueError("this tokenizer treats Latin words in another way: set latin_merges to False")

    def _stem(self, word: str) -> str:
        """The word in lower case without its comma or full stop, if merges alone are enough for it, else nothing."""
        stem = word[:-1] if word[-1:] in (",", ".") else word
        if self.merges is None or not stem.isalpha() or not (stem.isascii() or max(stem) < "\u0250"):
            return ""
        low = stem.lower()
        return low if len(low) == len(stem) else ""

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def _by_merges(self, words: list[str], stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self.merges.merged([s.encode() for s in stems])
        last = np.array([w[-1] for w in words])
        ends = np.cumsum(sizes)
        for mark, (mark_ids, _) in self.marks.items():
            at = np.flatnonzero(last == mark)
            ids = np.insert(ids, np.repeat(ends[at], len(mark_ids)), np.tile(mark_ids, len(at)))
            sizes = sizes + np.where(last == mark, len(mark_ids), 0)
            ends = np.cumsum(sizes)
        return ids, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        if len(self.pool.at) > REMEMBER:
            self.pool = Pool()
        cut_up = [t.replace("\n", " ").split(" ") for t in texts]
        words = [w for c in cut_up for w in c]
        new = set(words).difference(self.pool.at)
        if new:
            plain = {w: s for w in new if (s := self._stem(w))}
            if plain:
                self.pool.add(list(plain), *self._by_merges(list(plain), list(plain.values())))
            rest = [w for w in new if w not in plain]
            self.pool.add(rest, *self._by_library(rest))
        index = self.pool.index(words)
        total = np.concatenate(([0], np.cumsum(self.pool.sizes[index])))
        ends = np.cumsum(np.array([len(c) for c in cut_up], np.int64))
        return self.pool.get(index), np.diff(total[np.concatenate(([0], ends))])


@lru_cache(maxsize=1)
def encoder_of(text: str, latin_merges: bool) -> LibraryEncoder:
    return LibraryEncoder(text, latin_merges)


def write_tokens(documents: DataFrame, tokenizer: str, folder: str | None = None, end: int = END, file_ids: int = FILE_IDS, latin_merges: bool = True) -> DataFrame:
    """Write the ids of all documents, each with `end` after it, in ascending doc_id order; returns the files.

    file, base (ids in all files before it), n_ids, documents. Null text counts as empty. Null doc_ids come first; rows
    of one doc_id follow a hash of their text, so rows repeated as a whole are next to each other. Documents are dealt to
    tasks by ranges of doc_id; each task writes files of its own, and only those of attempts that counted are named.
    The folder is opened by pyarrow (file, s3, gs, hdfs), so the workers need its credentials. latin_merges: see
    LibraryEncoder.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())
    folder = folder or scratch(documents.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encoder, part, nth, writer, name = encoder_of(shared.value, latin_merges), TaskContext.get().partitionId(), 0, None, ""

        def done() -> pa.RecordBatch:
            writer.close()
            writer.stream.close()
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "part": [part], "nth": [nth], "n_ids": [writer.n], "documents": [len(writer.docs)]})

        for batch in batches:
            _, offsets = flat(batch.column("text"))
            for i, j in blocks(offsets, 1 << 20):
                ids, n = encoder.encode([x or "" for x in batch.column("text")[i:j].to_pylist()])
                ends = np.cumsum(n)
                for doc_id, a, b in zip(batch.column("doc_id")[i:j].to_pylist(), (ends - n).tolist(), ends.tolist(), strict=True):
                    if writer is None:
                        name = f"{uuid.uuid4().hex}.ids"
                        writer = Writer(store.open_output_stream(f"{root}/{name}", compression=None))
                    writer.add(doc_id, np.append(ids[a:b], end))
                    if writer.n >= file_ids:
                        yield done()
                        writer, nth = None, nth + 1
        if writer is not None:
            yield done()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    files = cut(map_batches(rows, write, "file string, part long, nth long, n_ids long, documents long"), "token-files")
    before = W.orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), "n_ids", "documents")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit little-endian)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(file)
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for doc_id, at, ids in read_file(source):
                        rows.append((doc_id, base + at, len(ids), ids.tobytes()))
                        held += len(ids)
                        if held >= 1 << 20 or len(rows) >= 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return map_batches(spread(files.select("file", "base")), read, "doc_id long, start long, n_tokens long, ids binary")

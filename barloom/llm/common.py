"""What the operators of this package share: batches, word spans and grouped streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.scratch import cut, discard, scratch  # noqa: F401
from ..functions.shipping import ship

#: A word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch of texts.
BATCH_ROWS = 1000
#: The bytes that separate words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def map_batches(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with this package at hand on the executors, whatever letters df's column names have."""
    ship(df.sparkSession)
    names = df.columns
    if not any("." in c or "`" in c for c in names):
        return df.mapInArrow(task, schema)
    # mapInArrow looks columns up by unquoted name, so they go by number on the way.
    numbered = df.toDF(*(f"_{k}" for k in range(len(names))))
    return numbered.mapInArrow(lambda batches: task(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches), schema)


#: Most tasks that read files; beyond so many files a task reads several.
MAX_READERS = 50_000


def spread(files: DataFrame) -> DataFrame:
    """files, a row for each file, dealt evenly over a task for each: a number that is given isn't coalesced."""
    return files.repartition(max(1, min(files.count(), MAX_READERS)))


def small_batches(spark: SparkSession) -> SparkSession:
    """spark, with Arrow batches of BATCH_ROWS rows unless the application sets a size: for applications, not operators.

    Texts are long, and several copies of a batch exist at once in the JVM and in Python.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(name) and spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column of our own that none of df's has."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """name, whatever letters it has, as Spark reads it in expressions."""
    return "`" + name.replace("`", "``") + "`"


def every(df: DataFrame) -> list[str]:
    """df's columns, quoted: names may hold dots and backticks."""
    return [quoted(c) for c in df.columns]


def columns_of(df: DataFrame) -> str:
    """df's columns, as a schema for map_batches."""
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def blocks(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with about `limit` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): the words of some rows; row r has words first[r] to first[r + 1]."""
    text, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    if not len(text):
        none = np.zeros(0, np.int64)
        return text, none, none, np.zeros(len(offsets), np.int64)
    word = ~_IS_SPACE[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[at] = True
    edge[0] = edge[-1] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    return text, starts, ends, np.searchsorted(starts, at)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles unsigned 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE, _BACK = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone."""
    if len(_tables[0]) < len(text) + 1:
        n = max(1 << 19, len(text)) + 1
        _tables[:] = [_powers(_BASE, n), _powers(_BACK, n)]
    run = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * _tables[0][: len(text)], out=run[1:])
    return mixed((run[ends] - run[starts]) * _tables[1][starts])


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `size` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (salt * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mixed(out)


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of a stream sorted by key: many small groups at once, or one large group."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if held and last == 0 and held[-1].column(key)[-1].as_py() == keys[-1]:
            held.append(table)
            continue
        if last:
            yield pa.concat_tables([*held, table.slice(0, last)]).combine_chunks()
            held = [table.slice(last)]
        else:
            if held:
                yield pa.concat_tables(held).combine_chunks()
            held = [table]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """Where the groups of sorted keys begin, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))

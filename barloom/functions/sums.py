"""Element-wise sums of arrays: how tasks' partial matrices and gradients meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship


def summed_arrays(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, column: the sum, element by element, of the arrays of doubles of each key; arrays of one key have one length.

    Rows come sorted by key and are added up as they stream by, so a task holds one sum whatever the number of arrays.
    A null array counts for nothing; a key without another has an empty sum.
    """
    ship(rows.sparkSession)
    rows = rows.select(*keys, column)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, schema = None, None, None
        for batch in batches:
            schema = batch.schema
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            arrays = batch.column(len(keys))
            values, ends = np.asarray(arrays.flatten(), float), np.cumsum(np.asarray(arrays.value_lengths().fill_null(0), np.int64))
            done = []
            for name, a, b in zip(names, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if held is not None and name != held:
                    done.append((held, total))
                    total = None
                held = name
                if b > a:
                    total = values[a:b].copy() if total is None else total + values[a:b]
            if done:
                yield made(done, schema)
        if held is not None:
            yield made([(held, total)], schema)

    def made(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([d[0][k] for d in done], schema.field(k).type) for k in range(len(keys))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([[] if t is None else t for _, t in done], pa.list_(pa.float64()))], names=[*keys, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, f"{schema}, `{column}` array<double>")


#: Doubles of products that a task holds before it hands on what it has.
HELD = 1 << 23


def summed_products(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, sums: for each key the number of rows, the sums of columns, and those of their products, the upper triangle by rows.

    Tasks add up matrices by key and hand them on when they hold HELD doubles, so memory is bounded whatever the number of
    keys or rows. Nulls count as 0.
    """
    ship(rows.sparkSession)
    upper = np.triu_indices(len(columns))
    rows = rows.select(*keys, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_{k}") for k, c in enumerate(columns)))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        schema = None

        def made() -> pa.RecordBatch:
            names = list(zip(*held, strict=True))
            out = pa.RecordBatch.from_arrays([*(pa.array(n, schema.field(k).type) for k, n in enumerate(names)), pa.array(list(held.values()), pa.list_(pa.float64()))], names=[*keys, "sums"])
            held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keys) :]])
            places: dict[tuple, list[int]] = {}
            for r, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[: len(keys)]), strict=True)):
                places.setdefault(key, []).append(r)
            for key, some in places.items():
                z = x[some]
                part = np.concatenate(([len(z)], z.sum(axis=0), (z.T @ z)[upper]))
                held[key] = held[key] + part if key in held else part
                if len(held) * len(part) > HELD:
                    yield made()
        if held:
            yield made()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    return summed_arrays(rows.mapInArrow(multiply, f"{schema}, sums array<double>"), keys, "sums")

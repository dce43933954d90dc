"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Vectors are scaled by the largest norm and lifted onto the unit sphere by one more component, so that the largest inner
product is the least Euclidean distance. Each of TABLES tables cuts `depth` Gaussian projections into cells of WIDTH. Given
a query's projections and the usual cosine between a vector and its neighbours, a neighbour's projections are normal too,
so every bucket has an estimated chance to hold one. A query visits the `probes` buckets of a table that promise most.
SAMPLE queries, whose true neighbours are found by scoring all vectors, give that cosine and the least number of probes at
which RECALL of their neighbours are met: how near neighbours are depends on the vectors, so no formula of the number
alone holds a recall. Buckets are dealt to shards of SHARD vectors or SHARD_COMPONENTS components, where they lie one after another; only the rows
of visited buckets are scored, and the best of each shard are merged. Shards that large buckets make too large are split,
and their queries are sent to every part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, group_bounds, map_batches, mixed

TABLES, WIDTH, SEED = 4, 2.0, 11
#: Cells per projection, around 0; a unit vector's projection is normal, so all but a few in 10,000 lie within.
CELLS, FIRST_CELL = 6, -3
#: Buckets in the order of chance / (share of vectors) ** THRIFT: with 0 few probes find most, with 1 few scored vectors do.
THRIFT = 0.6
#: Most buckets that a query visits in a table, and most projections in a key (CELLS ** MAX_DEPTH fits 63 bits).
MAX_PROBES, MAX_DEPTH = 2048, 24
#: Vectors in one shard at most, and the components that they have at most; a shard of more than twice as many is split.
#: A query goes to every shard that it visits, so the fewer shards, the fewer its copies.
SHARD, SHARD_COMPONENTS = 131_072, 1 << 23
#: Queries that a task holds at once, and the buckets that they visit.
HELD_QUERIES, HELD_BUCKETS = 8192, 1 << 22
#: Up to so many shards, the table of those to split is broadcast (some 40 bytes each).
BROADCAST_SHARDS = 500_000
#: Queries whose recall is measured against all vectors, and the recall of those that the probes must reach.
SAMPLE, RECALL = 128, 0.94
#: So many lengths of vectors, the most common ones, have tables of their own; all vectors of a rarer length are scored.
TABLED_LENGTHS = 64


def shard_size(dims: int) -> int:
    """The vectors of a shard, by their length."""
    return max(1, min(SHARD, SHARD_COMPONENTS // max(1, dims)))


def depth_of(n: int) -> int:
    """The projections in a key that n vectors are worth; fewer are taken where recall asks for them."""
    return min(MAX_DEPTH, max(3, round(math.log2(max(2, n)) / 1.65)))


_erf = np.vectorize(math.erf, otypes=[float])
_GRID = np.linspace(-9, 9, 18_001)
_NORMAL = 0.5 * (1 + _erf(_GRID / math.sqrt(2)))


def _below(z: np.ndarray) -> np.ndarray:
    """The chance of a standard normal variable below z, from a table."""
    return np.interp(z, _GRID, _NORMAL)


class Tables:
    """The hash functions: buckets of vectors, and the buckets that queries visit."""

    def __init__(self, dims: int, depth: int, largest: float, cosine: float = 0.5, probes: int = 1, tables: int = TABLES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.depth, self.largest, self.cosine, self.probes, self.tables, self.width = depth, largest, cosine, probes, tables, width
        self.directions = rng.normal(size=(tables, dims + 1, depth))
        self.offsets = rng.uniform(0, width, (tables, depth))

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        """A bucket for each vector (rows) and table (columns)."""
        x = x / self.largest
        x = np.hstack((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))))
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            cells = np.floor((x @ self.directions[t] + self.offsets[t]) / self.width).astype(np.int64)
            for cell in np.clip(cells - FIRST_CELL, 0, CELLS - 1).T:
                out[:, t] = out[:, t] * CELLS + cell
        return out

    def of_queries(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The buckets that each query (first axis) visits in each table (second axis), the most promising first.

        A bucket's score is a sum over projections, so the best prefixes of each length hold the best buckets. Where
        there are fewer buckets than probes, -1 fills up.
        """
        probes = probes or self.probes
        x = np.hstack((x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros((len(x), 1))))
        out = np.full((len(x), self.tables, probes), -1, np.int64)
        spread = math.sqrt(max(1e-6, 1 - self.cosine**2))
        low = np.arange(CELLS + 1) + FIRST_CELL
        for t in range(self.tables):
            at = self.cosine * (x @ self.directions[t])
            score, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
            for d in range(self.depth):
                edges = low * self.width - self.offsets[t, d]
                edges[0], edges[-1] = -np.inf, np.inf
                share = np.maximum(np.diff(_below(edges)), 1e-9)
                chance = np.maximum(np.diff(_below((edges - at[:, d, None]) / spread), axis=1), 1e-9)
                score = (score[:, :, None] + (np.log(chance) - THRIFT * np.log(share))[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * CELLS + np.arange(CELLS)).reshape(len(x), -1)
                if score.shape[1] > probes:
                    best = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
                    score, code = np.take_along_axis(score, best, 1), np.take_along_axis(code, best, 1)
            order = np.argsort(-score, axis=1, kind="stable")
            out[:, t, : score.shape[1]] = np.take_along_axis(code, order, 1)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _shard_of(buckets: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each bucket, by table (second axis)."""
    shape = (1, -1) + (1,) * (buckets.ndim - 2)
    return (mixed(buckets.view(np.uint64)) % np.uint64(shards)).astype(np.int64) + shards * np.arange(buckets.shape[1]).reshape(shape)


def _placed(batches: Iterator[pa.RecordBatch], tables: Tables, shards: int) -> Iterator[pa.RecordBatch]:
    """The shard of each vector in each table."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(tables.of_vectors(_matrix(batch.column("vector"))), shards).reshape(-1))], names=["shard"])


def _dealt(batches: Iterator[pa.RecordBatch], tables: Tables, shards: int) -> Iterator[pa.RecordBatch]:
    """A row for each point and each shard that holds its buckets (vectors) or that it visits (queries)."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            x, ids, vectors = _matrix(part.column("vector")), part.column("point").to_numpy(), part.column("vector")
            asks = part.column("query").to_numpy(zero_copy_only=False).astype(bool)
            for query in (False, True):
                at = np.flatnonzero(asks) if query else np.arange(len(x))
                if not len(at):
                    continue
                buckets = tables.of_queries(x[at]) if query else tables.of_vectors(x[at])[:, :, None]
                shard = _shard_of(buckets, shards).reshape(-1)
                owner, buckets = np.repeat(at, buckets.shape[1] * buckets.shape[2]), buckets.reshape(-1)
                real = buckets >= 0
                order = np.lexsort((buckets[real], shard[real], owner[real]))
                owner, shard, buckets = owner[real][order], shard[real][order], buckets[real][order]
                begin = group_bounds(owner * (shards * tables.tables) + shard)
                first = begin[:-1]
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[first]), pa.array(np.full(len(first), query)), pa.array(ids[owner[first]]), lists, vectors.take(pa.array(owner[first]))],
                    names=["shard", "query", "point", "buckets", "vector"],
                )


class Bucketed:
    """A shard's vectors, bucket by bucket."""

    def __init__(self, parts: list[pa.RecordBatch]):
        buckets = np.concatenate([p.column("buckets").flatten().to_numpy() for p in parts])
        order = np.argsort(buckets, kind="stable")
        self.x = np.concatenate([_matrix(p.column("vector")) for p in parts])[order]
        self.ids = np.concatenate([p.column("point").to_numpy() for p in parts])[order]
        self.bounds = group_bounds(buckets[order])
        self.names = buckets[order][self.bounds[:-1]]
        #: Products of a query and a vector computed so far.
        self.scored = 0

    def best(self, parts: list[pa.RecordBatch], keep: int) -> pa.RecordBatch:
        """For each query, the best `keep` vectors of the buckets that it visits, and what ties with the last of them.

        One product of matrices for each bucket and its visitors. A query's keep-th best so far bars what is worse.
        """
        y = np.concatenate([_matrix(p.column("vector")) for p in parts])
        points = np.concatenate([p.column("point").to_numpy() for p in parts])
        lists = [p.column("buckets") for p in parts]
        wanted = np.concatenate([c.flatten().to_numpy() for c in lists])
        visitor = np.repeat(np.arange(len(y)), np.concatenate([np.asarray(c.value_lengths()) for c in lists]))
        order = np.argsort(wanted, kind="stable")
        wanted, visitor = wanted[order], visitor[order]
        left, right = np.searchsorted(wanted, self.names), np.searchsorted(wanted, self.names, "right")
        bar, limit = np.full(len(y), -np.inf), max(1 << 16, 4 * keep * len(y))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def settled(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, p, s = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((-s, q))
            q, p, s = q[order], p[order], s[order]
            first = group_bounds(q)
            last = first[:-1] + keep - 1
            full = last < first[1:]
            worst = s[last[full]]
            bar[q[last[full]]] = worst - 1e-9 * np.maximum(1, np.abs(worst))
            good = s >= bar[q]
            return q[good], p[good], s[good]

        for b in np.flatnonzero(right > left):
            who = visitor[left[b] : right[b]]
            rows = slice(self.bounds[b], self.bounds[b + 1])
            score = y[who] @ self.x[rows].T
            self.scored += score.size
            i, j = np.nonzero(score >= bar[who, None])
            if len(i):
                held.append((who[i], j + rows.start, score[i, j]))
                n += len(i)
            if n >= limit:
                held = [settled(held)]
                n, limit = len(held[0][0]), len(held[0][0]) + max(1 << 16, 2 * keep * len(y))
        if not held:
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        q, p, _ = settled(held)
        exact = (y[q] * self.x[p]).sum(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(points[q]), pa.array(self.ids[p]), pa.array(exact)], names=["query", "point", "score"])


def _scored(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shard, vectors before queries: the best of each shard for each query that visits it.

    A task holds one shard's vectors and HELD_QUERIES queries at a time, or fewer that visit HELD_BUCKETS buckets.
    """
    of, vectors, queries, n, visits, index = None, [], [], 0, 0, None

    def answers() -> Iterator[pa.RecordBatch]:
        nonlocal queries, n, visits, index
        if vectors and queries:
            index = index or Bucketed(vectors)
            yield index.best(queries, keep)
        queries, n, visits = [], 0, 0

    for batch in batches:
        shard, asks = batch.column("shard").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False).astype(bool)
        edge = np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
        bounds = [0, *edge.tolist(), len(shard)] if len(shard) else []
        for a, b in pairwise(bounds):
            if shard[a] != of:
                yield from answers()
                of, vectors, index = shard[a], [], None
            if asks[a]:
                queries.append(batch.slice(a, b - a))
                n += b - a
                visits += len(queries[-1].column("buckets").flatten())
                if n >= HELD_QUERIES or visits >= HELD_BUCKETS:
                    yield from answers()
            else:
                vectors.append(batch.slice(a, b - a))
    yield from answers()


def _best_of_all(batches: Iterator[pa.RecordBatch], ids: np.ndarray, y: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """For each of the queries y (points `ids`), the best k other points of a task's rows, all of which are scored."""
    score, point = np.zeros((len(y), 0)), np.zeros((len(y), 0), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        here = batch.column("point").to_numpy()
        more = y @ _matrix(batch.column("vector")).T
        more[ids[:, None] == here[None, :]] = -np.inf
        score, point = np.hstack((score, more)), np.hstack((point, np.broadcast_to(here, more.shape)))
        if score.shape[1] > k:
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            score, point = np.take_along_axis(score, top, 1), np.take_along_axis(point, top, 1)
    i, j = np.nonzero(np.isfinite(score))
    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(point[i, j]), pa.array(score[i, j])], names=["query", "point", "score"])


def _ranks(tables: Tables, pairs: list[tuple[np.ndarray, np.ndarray]], probes: int) -> np.ndarray:
    """For each true neighbour (rows of the second) of each query (the first): after how many probes it is met first."""
    out = []
    for y, near in pairs:
        visited, held = tables.of_queries(y[None, :], probes)[0], tables.of_vectors(near)
        match = visited[None, :, :] == held[:, :, None]
        out.append(np.where(match.any(2), match.argmax(2), probes).min(1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def fitted_tables(points: DataFrame, asked: DataFrame, size: int, dims: int, largest: float, k: int) -> Tables:
    """Tables and probes whose recall, over SAMPLE queries by hash against all points (point, vector), is RECALL at least.

    The depth is depth_of(size), or less where MAX_PROBES don't reach RECALL. Depth 0 puts all vectors in one bucket, so
    there is always an answer. Each task scores its rows and passes k on a query.
    """
    sample = points.join(asked.select(F.col("query").alias("point")).distinct(), "point", "left_semi").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
    if not sample:
        return Tables(dims, depth_of(size), largest)
    ids, y = np.array([r["point"] for r in sample], np.int64), np.array([r["vector"] for r in sample], float)
    best = map_batches(points.select("point", "vector"), lambda b: _best_of_all(b, ids, y, k), "query long, point long, score double")
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "point"))
    best = best.withColumn("nth", nth).where(F.col("nth") <= k).select("query", "point")
    near: dict[int, list] = {}
    for r in points.join(F.broadcast(best), "point").select("query", "vector").collect():
        near.setdefault(r["query"], []).append(r["vector"])
    pairs = [(v, np.array(near[i], float)) for i, v in zip(ids.tolist(), y, strict=True) if i in near]
    # On the lifted sphere a query has length 1 and a vector's product with it is scaled by the largest norm.
    cosines = [float((n @ v).mean() / (np.sqrt(v @ v) * largest)) for v, n in pairs]
    cosine = min(0.98, max(0.05, float(np.median(cosines)))) if cosines else 0.5
    for depth in range(depth_of(size), 0, -1):
        tables = Tables(dims, depth, largest, cosine)
        ranks = np.sort(_ranks(tables, pairs, MAX_PROBES))
        needed = math.ceil(RECALL * len(ranks))
        if needed <= np.count_nonzero(ranks < MAX_PROBES):
            tables.probes = int(ranks[needed - 1]) + 1 if needed else 1
            return tables
    return Tables(dims, 0, largest, tables=1)


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector: rows with an id whose components are all finite and not all zero; floats stay floats."""
    kind = vectors.schema["embedding"].dataType
    vector = F.col("embedding").cast("array<float>" if kind.simpleString() == "array<float>" else "array<double>")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), (finite & F.exists(vector, lambda v: v != 0)).alias("ok"))
    return rows.where("ok and vec_id is not null").select("vec_id", "vector")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) with is_query, the k nearest others found.

    Nearest: the largest inner product in double precision, ties to the smaller vec_id. Fewer candidates give fewer rows.
    Rows without an id and vectors that are null, zero, or hold null or non-finite components take no part; vectors of
    several lengths are searched each among those of its own length, beyond TABLED_LENGTHS lengths by scoring all of them.
    Equal vectors are searched as one, and stand for as many ids as a result can hold; rows that repeat a vec_id with one
    vector count once, and with several vectors each count. Columns besides vec_id and embedding take no part, except in is_query.
    """
    rows = cut(_usable(vectors), "vectors")
    length = F.size("vector")
    sizes = rows.groupBy(length.alias("n")).count().orderBy(F.desc("count"), "n").limit(TABLED_LENGTHS + 1).collect()
    lengths = [r["n"] for r in sizes[:TABLED_LENGTHS]]
    found = [_nearest(rows if len(sizes) == 1 else rows.where(length == n), is_query, k) for n in lengths]
    if len(sizes) > TABLED_LENGTHS:
        found.append(_nearest_of_all(rows.where(~length.isin(lengths)), is_query, k))
    out = rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false") if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out if len(found) < 2 else out.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _distinct(rows: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points: a number for each distinct vector, and its ids; asked: query_id and its point; point, query, vector), from rows (vec_id, vector)."""
    by_id = W.partitionBy("vector").orderBy("vec_id")
    leading = rows.distinct().withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    points = cut(leading.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("point", F.monotonically_increasing_id()), "points")
    asked = rows.where(is_query).distinct().join(points.select("vector", "point"), "vector").select(F.col("vec_id").alias("query_id"), F.col("point").alias("query"))
    asked = cut(asked, "queries")
    marked = points.join(asked.select(F.col("query").alias("point"), F.lit(True).alias("query")).distinct(), "point", "left").select("point", F.coalesce("query", F.lit(False)).alias("query"), "vector")
    return points, asked, marked


def _answers(dealt: DataFrame, tasks: int, points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from vectors and queries dealt to shards: a task for each, up to a number that any cluster can schedule."""
    split = dealt.repartition(max(1, min(tasks, 100_000)), "shard").sortWithinPartitions("shard", "query")
    found = map_batches(split, lambda b: _scored(b, k + 1), "query long, point long, score double")
    pairs = found.groupBy("query", "point").agg(F.max("score").alias("score"))
    best = F.rank().over(W.partitionBy("query").orderBy(F.desc("score")))
    pairs = pairs.withColumn("nth", best).where(F.col("nth") <= k + 1).join(points.select("point", "ids"), "point")
    pairs = pairs.select("query", "score", F.explode("ids").alias("vec_id"))
    answers = asked.join(pairs, "query").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _nearest_of_all(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """nearest, for rows (vec_id, vector) of rare lengths: exact. A shard holds vectors of one length, all in one bucket."""
    points, asked, marked = _distinct(rows, is_query, k)
    most = points.agg(F.max(F.size("vector"))).first()[0]
    sizes = cut(points.groupBy(F.size("vector").alias("n")).agg(F.ceil(F.count("*") / shard_size(most)).alias("v")), "rare-lengths")
    placed = marked.join(sizes, F.size("vector") == F.col("n"))
    # A length's parts are numbered in the low 32 bits. A vector goes to one of them, a query to all.
    shard = lambda part: F.shiftleft(F.col("n").cast("long"), 32) + part
    row = lambda part, query: (shard(part).alias("shard"), F.lit(query).alias("query"), "point", F.array(F.lit(0).cast("long")).alias("buckets"), "vector")
    held = placed.select(*row(F.pmod(F.xxhash64("point"), F.col("v")), False))
    asking = placed.where("query").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("v") - 1))).select(*row(F.col("part"), True))
    return _answers(held.unionByName(asking), sizes.agg(F.coalesce(F.sum("v"), F.lit(1))).first()[0], points, asked, k)


def _nearest(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """nearest, for rows (vec_id, vector) of one length."""
    points, asked, marked = _distinct(rows, is_query, k)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    size, largest, dims = points.agg(F.count("*"), F.max(norm), F.max(F.size("vector"))).first()
    tables = fitted_tables(points, asked, size, dims, largest, k)
    each = shard_size(dims)
    shards = max(1, size // each)
    vector = points.schema["vector"].dataType.simpleString()
    placed = map_batches(points.select("vector"), lambda b: _placed(b, tables, shards), "shard long")
    large = cut(placed.groupBy("shard").agg(F.count("*").alias("v")).where(F.col("v") > 2 * each).select("shard", F.ceil(F.col("v") / each).alias("v")), "large-shards")
    dealt = map_batches(marked, lambda b: _dealt(b, tables, shards), f"shard long, query boolean, point long, buckets array<long>, vector {vector}")
    n_large = large.count()
    if n_large:
        # A vector goes to one part of a large shard, a query to every part.
        split = dealt.join(F.broadcast(large) if n_large <= BROADCAST_SHARDS else large, "shard", "left")
        parts = F.when(F.col("v").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("query"), F.sequence(F.lit(0).cast("long"), F.col("v") - 1)).otherwise(F.array(F.pmod(F.xxhash64("point"), F.col("v"))))
        split = split.withColumn("part", F.explode(parts))
        dealt = split.select(F.when(F.col("v").isNull(), F.col("shard")).otherwise(F.xxhash64("shard", "part")).alias("shard"), "query", "point", "buckets", "vector")
    return _answers(dealt, shards * tables.tables + n_large, points, asked, k)

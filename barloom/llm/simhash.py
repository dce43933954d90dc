"""SimHash near-dedup: fingerprints, exact pairs within a Hamming radius by vantage-point trees, and their components.

In 64 dimensions a ball of radius 4 overlaps most median splits, so trees over all fingerprints would prune little. The
trees therefore stand behind an exact sieve: of six blocks of a fingerprint, four differing bits leave two untouched, so
a pair within the radius meets in one of 15 shards keyed by two blocks. Each shard has a vantage-point tree: its points
branch by their distance from a first vantage point and then from a second, and by the triangle inequality a branch meets
only branches within the radius in both distances. Shards above MAX_SHARD are first split by Hamming distance from a
vantage point, sending what lies near the boundary to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_key, cut, discard, flat, fresh, group_bounds, map_batches, quoted

SHINGLE, SEED, RADIUS = 4, 42, 4
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Larger shards are split by vantage points, for so many rounds; what is still larger is searched in pairs of parts.
MAX_SHARD, ROUNDS = 8192, 3
#: Pairs of points that a task looks at together.
PAIRS = 1 << 21


def _word_lists(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in parts of about `size` bytes."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set in more than half of the shingles' hashes; 0 for a text without words."""
    hashed, total, ones, tail = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64), []
    for words in _word_lists(text.lower()):
        words = tail + words
        if len(words) >= shingle:
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = (ends - [len(w) + 1 for w in words]).tolist()
            line = b" ".join(words)
            hs = np.array([hashed(line[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)], np.uint64)
            ones += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hs)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not total and tail:
        return hashed(b" ".join(tail), seed)
    return int((2 * ones > total) @ (1 << np.arange(64, dtype=np.uint64))) if total else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = batch.schema.get_field_index("text")
        data, at = flat(batch.column(place))
        found = np.array([fingerprint(data[at[r] : at[r + 1]].tobytes()) for r in range(batch.num_rows)], np.uint64)
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found.view(np.int64))], names=[*rest.schema.names, "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), digest (a 64-bit hash of the text) of every row; null text counts as empty."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    return map_batches(rows, _fingerprints, "doc_id long, digest long, fp long")


class Forest:
    """Sets of points that links join; each set is named by its least point."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while (up := self.parent[r]) is not None and (up != r).any():
            r = up
        self.parent[i] = r
        return r

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def tree_links(x: np.ndarray, bounds: np.ndarray, forest: Forest, radius: int = RADIUS, step: int = PAIRS) -> tuple[int, int]:
    """Joins all points within radius of one shard, for shards bounds[k] to bounds[k + 1] of x; (pairs of one shard, pairs compared).

    A shard's root branches by the distance from its first point, each branch by the distance from the point farthest
    from that. Points in the order of those distances have the branches that the triangle inequality allows right behind
    them: the first distance bounds a run of points, the second sieves it, and only what is left is compared.
    """
    shard = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    one = np.bitwise_count(x ^ x[bounds[:-1]][shard]).astype(np.int64)
    order = np.lexsort((one, shard))
    far = order[bounds[1:] - 1] if len(shard) else order
    two = np.bitwise_count(x ^ x[far][shard]).astype(np.int16)
    key = (shard * 256 + one)[order]
    two, points = two[order], x[order]
    here = np.arange(len(x))
    # The run of point i: those behind it in its shard, at most radius further from the first vantage point.
    length = np.searchsorted(key, key + radius, "right") - here - 1
    sizes = np.diff(bounds)
    compared, ends = 0, np.cumsum(length)
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, "right")))
        i = np.repeat(here[a:b], length[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[a:b] - length[a:b] - (ends[a - 1] if a else 0), length[a:b])
        near = np.abs(two[i] - two[j]) <= radius
        i, j = i[near], j[near]
        compared += len(i)
        linked = np.bitwise_count(points[i] ^ points[j]) <= radius
        forest.link(order[i[linked]], order[j[linked]])
        a = b
    return int((sizes * (sizes - 1) // 2).sum()), compared


def _shard_links(batches: Iterator[pa.RecordBatch], counts: bool = False) -> Iterator[pa.RecordBatch]:
    """From fingerprints sorted by shard: for each, the least one of its shard that links join it to; or what it took."""
    for table in by_key(batches, "shard"):
        keys, fps = table.column("shard").to_numpy(), np.ascontiguousarray(table.column("fp").to_numpy()).view(np.uint64)
        order = np.lexsort((fps, keys))
        fps, forest = fps[order], Forest(len(fps))
        pairs, compared = tree_links(fps, group_bounds(keys[order]), forest)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([compared])], names=["pairs", "compared"])
            continue
        root = forest.roots(np.arange(len(fps)))
        moved = root != np.arange(len(fps))
        yield pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)), pa.array(fps[root[moved]].view(np.int64))], names=["a", "b"])


def _split_by_vantage(shards: DataFrame, large: DataFrame) -> DataFrame:
    """Shards in large, each split at the median distance from its least fingerprint; the inner band goes to both sides."""
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
    rows = shards.join(large, "shard").withColumn("far", far)
    middle = rows.groupBy("shard", "far").agg(F.count("*").alias("n"))
    middle = middle.groupBy("shard").agg(F.expr("percentile(far, 0.5, n)").cast("int").alias("middle"))
    rows = rows.join(middle, "shard")
    sides = F.array_compact(F.array(F.when(F.col("far") <= F.col("middle"), F.lit(0)), F.when(F.col("far") > F.col("middle") - RADIUS, F.lit(1))))
    return rows.select("shard", "fp", F.explode(sides).alias("side")).select(F.xxhash64("shard", "side").alias("shard"), "fp")


def _sharded(points: DataFrame, max_shard: int, rounds: int) -> DataFrame:
    """shard, fp: every two fingerprints of points within RADIUS share a shard; sorted by shard within partitions."""
    fp, keys = F.col("fp"), []
    for n, pair in enumerate(combinations(BLOCKS, 2)):
        key = F.lit(n).cast("long")
        for shift, width in pair:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(key)
    shards = points.select("fp", F.explode(F.array(*keys)).alias("shard")).select("shard", "fp")
    sizes = lambda s: s.groupBy("shard").agg(F.count("*").alias("n"), F.min("fp").alias("vantage")).where(F.col("n") > max_shard)
    large = cut(sizes(shards), "large-shards")
    done = []
    for _ in range(rounds):
        if large.isEmpty():
            break
        names = large.select("shard")
        done.append(shards.join(names, "shard", "left_anti"))
        shards = cut(_split_by_vantage(shards, large.select("shard", "vantage")), "split-shards")
        large = cut(sizes(shards), "large-shards")
    if not large.isEmpty():
        # Still large: every two parts of such a shard are searched in a shard of their own.
        parts = shards.join(large.select("shard", F.ceil(F.col("n") * 2 / max_shard).alias("k")), "shard").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")))
        with_each = parts.select("shard", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
        done.append(with_each.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "fp"))
        shards = shards.join(large.select("shard"), "shard", "left_anti")
    for other in done:
        shards = shards.unionByName(other)
    return shards.repartition("shard").sortWithinPartitions("shard")


def links(points: DataFrame, max_shard: int = MAX_SHARD, rounds: int = ROUNDS) -> DataFrame:
    """a, b: edges that join all fingerprints of points (distinct, column fp) within RADIUS into their components."""
    return map_batches(_sharded(points, max_shard, rounds), _shard_links, "a long, b long")


def work(points: DataFrame, max_shard: int = MAX_SHARD, rounds: int = ROUNDS) -> DataFrame:
    """pairs, compared: how many pairs of fingerprints share a shard, and how many the trees leave to compare."""
    counted = map_batches(_sharded(points, max_shard, rounds), lambda b: _shard_links(b, True), "pairs long, compared long")
    return counted.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of edges (a, b) reaches, itself included; for nodes with edges.

    Large star, small star: every node hands its neighbours the least one, in turn upwards and downwards, until nothing
    changes. Each step reduces by key before it shuffles, and ends in a table of its own: the joins read tables on both
    sides, so that Spark may split the edges of a node that has very many.
    """
    greater = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, last = cut(greater(edges), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if mark == last or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        up = cut(greater(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "edges")
        discard(now, least)
        least = cut(up.groupBy("a").agg(F.min("b").alias("m")), "least")
        now = cut(greater(up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))), "edges")
        discard(up, least)


def _named(rows: DataFrame) -> DataFrame:
    """of, first: for each fingerprint of rows (doc_id, digest, fp), the least (no id, doc_id, digest) that links reach."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    points = cut(rows.groupBy("fp").agg(first), "points")
    roots = components(links(points.select("fp")))
    named = points.join(roots, points["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    firsts = named.groupBy("root").agg(F.min("first").alias("first"))
    return named.select("fp", "root").join(firsts, "root").select(F.col("fp").alias("of"), "first")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that links of at most RADIUS bits reach.

    Null and wordless texts have fingerprint zero and link like others; a row without doc_id never names a component,
    which is null where no row of it has one. Rows that repeat a doc_id each get a row.
    """
    rows = cut(fingerprints(documents), "fingerprints")
    joined = rows.join(_named(rows), F.col("fp") == F.col("of"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, that with the least doc_id.

    Of rows that share the least doc_id, the first by a hash of its text stays, and of rows that share both, the first by
    a hash of all columns that have an order. Rows without doc_id come last: one of them stays where a group has no others.
    """
    rows = cut(fingerprints(documents), "fingerprints")
    joined = rows.join(_named(rows), F.col("fp") == F.col("of"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    gone_id, gone_digest = fresh(documents, "gone_id"), fresh(documents, "gone_digest")
    key = documents["doc_id"].cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == F.col(gone_digest))
    of = lambda df: df.select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest))
    kept = documents.join(of(joined.where(~same).select("doc_id", "digest").distinct()), key, "left_anti")
    repeated = cut(of(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1")), "repeated-rows")
    if repeated.isEmpty():
        return kept
    nth = fresh(documents, "nth")
    hashed = [F.col(quoted(f.name)) for f in documents.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    window = W.partitionBy("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.xxhash64(*hashed))
    some = kept.join(repeated, key, "left_semi").withColumn(nth, F.row_number().over(window)).where(F.col(nth) == 1)
    return kept.join(repeated, key, "left_anti").unionByName(some.drop(nth))

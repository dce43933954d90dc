"""The trie of conversation prefixes, with totals over every subtree rolled up by centroid decomposition.

A node is the distinct sequence of a conversation's first turns, named by a 128-bit hash of it. Numbering and hashes run
over rows that are sorted across partitions, so that no task needs a whole conversation. The forest of edges to parents is
split at centroids until its components are small: in each round every large component loses the node that leaves no piece
of more than half of it; what hangs under that node is summed up, and the total is added to it and to each node on the way
from it to the component's top. Components that are small enough are taken apart the same way inside tasks, many at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, by_key, cut, discard, map_batches

#: Conversations come in families of FAMILY, whose first member lends its opening to the others.
FAMILY, OPENINGS = 20, 4
#: Nodes in a component that one task takes apart.
SMALL = 10_000
#: Characters of member lists that meet in one row before they are hashed.
PIECE = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()

_NODE = ["n1", "n2"]
_PARENT = ["p1", "p2"]
_COMP = ["c1", "c2"]


def _longs(md5: Column) -> list[Column]:
    """The two halves of an MD5, as longs."""
    return [F.conv(F.substring(md5, a, 16), 16, -10).cast("long") for a in (1, 17)]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, said (MD5 of role and text), words; rows without conv_id go, null role and text count as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said.alias("said"), words.alias("words"))


def _rolled(rows: DataFrame, order: list[Column], hashed: bool, label: str) -> DataFrame:
    """rows, sorted by conv_id and order, with nth, or with hashed a running xor of columns x1 and x2, over the conversation.

    Partitions hold ranges of the sorted rows. Each rolls over its own; a conversation that goes on from earlier ones gets
    their total added, and there is at most one such conversation a partition.
    """

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carry = None, [0, 0, 0]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id").to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1))
            first = np.repeat(starts, np.diff(np.concatenate((starts, [n]))))
            goes_on = (conv == last) & (first == 0) if last is not None else np.zeros(n, bool)
            columns, names = list(batch.columns), list(batch.schema.names)
            nth = np.arange(n) - first + 1 + np.where(goes_on, carry[0], 0)
            state = [int(nth[-1])]
            for k, name in enumerate(("x1", "x2") if hashed else ()):
                run = np.concatenate(([0], np.bitwise_xor.accumulate(batch.column(name).to_numpy())))
                rolled = run[1:] ^ run[first] ^ np.where(goes_on, carry[k + 1], 0)
                state.append(int(rolled[-1]))
                columns.append(pa.array(rolled))
                names.append(_NODE[k])
            if not hashed:
                columns.append(pa.array(nth))
                names.append("nth")
            last, carry = conv[-1], [*state, 0, 0][:3]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int32))], names=[*names, "part"])

    made = _NODE if hashed else ["nth"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"{c} long" for c in made] + ["part int"])
    ordered = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    table = cut(map_batches(ordered, roll, schema), label)
    totals = table.groupBy("conv_id", "part").agg(*([F.bit_xor(x).alias(c) for x, c in zip(("x1", "x2"), made, strict=True)] if hashed else [F.max("nth").alias("nth")]))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    earlier = totals.select("conv_id", "part", *((F.bit_xor(c) if hashed else F.sum(c)).over(before).alias(f"{c}_0") for c in made)).where(F.col(f"{made[0]}_0").isNotNull())
    whole = table.join(F.broadcast(earlier), ["conv_id", "part"], "left")  # a row a partition at most
    add = lambda c: F.col(c).bitwiseXOR(F.coalesce(f"{c}_0", F.lit(0))) if hashed else F.col(c) + F.coalesce(f"{c}_0", F.lit(0))
    return whole.select(*rows.columns, *(add(c).alias(c) for c in made))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, depth, said, words; conversations: conv_id): every conversation with the opening of its family.

    The first h turns of conversation c come from conversation c - c % FAMILY (all it has, if fewer; none if there is no
    such conversation), the others are its own after the first h; h is crc32 of c in decimal, modulo OPENINGS. Turns come
    in the order of turn, null first; equal ones in the order of an MD5 of role and text. Repeated rows are turns of
    their own.
    """
    of = lambda c: c - c % FAMILY
    lent = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(OPENINGS))
    numbered = _rolled(_turns(conversations), [F.asc_nulls_first("turn"), F.asc("said")], False, "numbered-turns")
    known = numbered.select("conv_id").distinct()
    openings = numbered.where((F.col("conv_id") % FAMILY == 0) & (F.col("nth") < OPENINGS))
    opening = openings.select(F.col("conv_id").alias("family"), "nth", "said", "words")
    members = known.select("conv_id", of(F.col("conv_id")).alias("family"), lent(F.col("conv_id")).alias("h"))
    borrowed = members.join(opening, "family").where(F.col("nth") <= F.col("h")).select("conv_id", F.col("nth").alias("depth"), "said", "words")
    sizes = openings.groupBy(F.col("conv_id").alias("family")).agg(F.max("nth").alias("size"))
    own = numbered.withColumns({"h": lent(F.col("conv_id")), "family": of(F.col("conv_id"))}).where(F.col("nth") > F.col("h")).join(sizes, "family", "left")
    own = own.select("conv_id", (F.col("nth") - F.col("h") + F.least("h", F.coalesce("size", F.lit(0)))).alias("depth"), "said", "words")
    return borrowed.unionByName(own), known


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, n1, n2, p1, p2, words: the nodes on each rebuilt conversation's way down, the root (0, 0) first.

    A node's name is the xor of one 128-bit hash for each place and what is said there.
    """
    turns, known = rebuilt(conversations)
    x1, x2 = _longs(F.md5(F.concat_ws(":", F.col("depth").cast("string"), "said")))
    rolled = _rolled(turns.select("conv_id", "depth", "words", x1.alias("x1"), x2.alias("x2")), [F.asc("depth")], True, "rolled-turns")
    parents = [F.col(n).bitwiseXOR(F.col(x)).alias(p) for n, x, p in zip(_NODE, ("x1", "x2"), _PARENT, strict=True)]
    rows = rolled.select("conv_id", "depth", *_NODE, *parents, "words")
    zero = F.lit(0).cast("long")
    roots = known.select("conv_id", zero.alias("depth"), *(zero.alias(c) for c in _NODE), *(F.lit(None).cast("long").alias(c) for c in _PARENT), zero.alias("words"))
    return cut(rows.unionByName(roots), "prefix-paths")


def trie(ways: DataFrame) -> DataFrame:
    """n1, n2, p1, p2, conv_id (the smallest member), depth, n_convs, n_children, parent_conv_id, words: a row a node."""
    nodes = ways.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), *(F.max(c).alias(c) for c in (*_PARENT, "words")))
    nodes = cut(nodes, "prefix-nodes")
    above = nodes.select(*(F.col(n).alias(p) for n, p in zip(_NODE, _PARENT, strict=True)), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("p1 is not null").groupBy(*(F.col(p).alias(n) for n, p in zip(_NODE, _PARENT, strict=True))).agg(F.count("*").alias("n_children"))
    return nodes.join(above, _PARENT, "left").join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))


def _sized(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """nodes with size, the nodes of the subtree.

    The nodes whose smallest member a conversation is are the lower end of its way, so a subtree holds all such nodes of
    its members but one, its top's smallest member, of which it holds those from the top down.
    """
    own = nodes.groupBy("conv_id").agg(F.count("*").alias("own"), F.max("depth").alias("deepest"))
    sums = ways.select("conv_id", *_NODE).join(own.select("conv_id", "own"), "conv_id").groupBy(*_NODE).agg(F.sum("own").alias("all"))
    rows = nodes.join(sums, _NODE).join(own, "conv_id")
    return rows.withColumn("size", F.col("all") - F.col("own") + F.col("deepest") - F.col("depth") + 1).drop("all", "own", "deepest")


def _taken_apart(parent: list[int], sizes: list[int], values: list[list[int]], added: list[list[int]]) -> None:
    """Adds to `added`, for each node, the total of values over its subtree.

    parent has a node's place, or -1 for a top; nodes stand after their parents. Each component in turn loses its
    centroid, and what still hangs under that is added to it and to every node above it; the pieces are components again.
    """
    n = len(parent)
    below: list[list[int]] = [[] for _ in range(n)]
    tops = []
    for v, p in enumerate(parent):
        (below[p] if p >= 0 else tops).append(v)
    gone = [False] * n
    while tops:
        top = c = tops.pop()
        half = sizes[top] / 2
        while True:  # down to the last node that holds more than half of the component
            for v in below[c]:
                if not gone[v] and sizes[v] > half:
                    c = v
                    break
            else:
                break
        totals = [0] * len(added)  # of what is still below; the nodes above know of the rest
        held = [c]
        while held:
            v = held.pop()
            for k, x in enumerate(values):
                totals[k] += x[v]
            held += [w for w in below[v] if not gone[w]]
        gone[c] = True
        for k, t in enumerate(totals):
            added[k][c] += t
        tops += [v for v in below[c] if not gone[v]]
        if c != top:
            tops.append(top)
        v = parent[c]
        while v >= 0 and not gone[v]:  # centroid to top
            sizes[v] -= sizes[c]
            for k, t in enumerate(totals):
                added[k][v] += t
            v = parent[v]


def _small_components(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of whole components, sorted by component, with their totals in place of what was added so far."""
    for table in by_key(batches, _COMP[0]):
        table = table.take(np.argsort(table.column("depth").to_numpy(), kind="stable"))
        ids = [list(zip(*(table.column(c).to_pylist() for c in pair), strict=True)) for pair in (_NODE, _PARENT, _COMP)]
        at = {node: k for k, node in enumerate(ids[0])}
        parent = [-1 if node == top else at[p] for node, p, top in zip(*ids, strict=True)]
        sizes = [1] * len(parent)
        for v in range(len(parent) - 1, -1, -1):
            if parent[v] >= 0:
                sizes[parent[v]] += sizes[v]
        added = [table.column(f"{c}_added").to_pylist() for c in names]
        _taken_apart(parent, sizes, [table.column(c).to_pylist() for c in names], added)
        for c, x in zip(names, added, strict=True):
            table = table.set_column(table.schema.get_field_index(f"{c}_added"), f"{c}_added", pa.array(x, pa.int64()))
        yield from table.to_batches(max_chunksize=10_000)


def rolled_up(nodes: DataFrame, ways: DataFrame, sums: dict[str, str], small: int = SMALL) -> DataFrame:
    """nodes with, for each name of sums, the total of a column of nodes over the subtree of each node.

    ways has the nodes on the way of each node's conv_id, by depth. Components above `small` nodes are split at their
    centroids by Spark, each round at least halving the largest; others in tasks. Every column of nodes stays.
    """
    names = list(sums)
    top = [F.lit(0).cast("long").alias(c) for c in _COMP]
    state = _sized(nodes, ways) if nodes.count() > small else nodes.withColumn("size", F.lit(0).cast("long"))
    state = state.select(*nodes.columns, "size", *top, *(F.col(c).cast("long").alias(f"_{name}") for name, c in sums.items()), *(F.lit(0).cast("long").alias(f"_{name}_added") for name in names))
    state = table = cut(state, "components")
    keep = [*nodes.columns, "size", *_COMP, *(f"_{n}" for n in names), *(f"_{n}_added" for n in names)]
    done: list[DataFrame] = []
    while True:
        large = state.groupBy(*_COMP).agg(F.max("size").alias("whole")).where(F.col("whole") > small)
        large = cut(large, "large-components")
        if large.isEmpty():
            break
        done.append(cut(state.join(large, _COMP, "left_anti").select(*keep, F.lit(False).alias("apart")), "small-components"))
        inside = state.join(large, _COMP)
        centre = inside.where(F.col("size") * 2 > F.col("whole")).groupBy(*_COMP).agg(F.min(F.struct("size", "depth", "conv_id", *_NODE)).alias("centre"))
        centre = cut(centre, "centroids")
        # A node lies under the centroid if its conversation's way passes there; the next node on it is its new top.
        under = inside.join(centre, _COMP).select(*keep, "centre", F.when(F.col("depth") > F.col("centre.depth"), F.col("centre.depth") + 1).alias("look"))
        next_ = ways.select(F.col("conv_id").alias("of"), F.col("depth").alias("at"), *(F.col(c).alias(f"next_{c}") for c in (*_NODE, *_PARENT)))
        under = under.join(next_, (F.col("conv_id") == F.col("of")) & (F.col("look") == F.col("at")), "left")
        is_centre = (F.col("n1") == F.col("centre.n1")) & (F.col("n2") == F.col("centre.n2"))
        is_under = F.coalesce((F.col("next_p1") == F.col("centre.n1")) & (F.col("next_p2") == F.col("centre.n2")), F.lit(False))
        under = cut(under.select(*keep, is_centre.alias("is_centre"), is_under.alias("is_under"), "next_n1", "next_n2"), "split-components")
        within = under.where("is_centre or is_under").groupBy(*_COMP).agg(*(F.sum(f"_{n}").alias(f"total_{n}") for n in names))
        totals = centre.join(within, _COMP)
        up = totals.select(F.col("centre.conv_id").alias("of"), F.col("centre.depth").alias("end"), F.col("centre.size").alias("less"), *(F.col(c).alias(f"up_{c}") for c in _COMP), *(f"total_{n}" for n in names))
        up = ways.join(up, (F.col("conv_id") == F.col("of")) & (F.col("depth") <= F.col("end"))).select(*(F.col(c).alias(f"way_{c}") for c in _NODE), "less", *(f"up_{c}" for c in _COMP), *(f"total_{n}" for n in names))
        same = [F.col(c) == F.col(f"way_{c}") for c in _NODE] + [F.col(c) == F.col(f"up_{c}") for c in _COMP]
        moved = under.join(up, same, "left")
        above = F.col("less").isNotNull() & ~F.col("is_centre")
        columns = {
            "size": F.when(above, F.col("size") - F.col("less")).otherwise(F.col("size")),
            **{c: F.when(F.col("is_under"), F.col(f"next_{n}")).otherwise(F.col(c)) for c, n in zip(_COMP, _NODE, strict=True)},
            **{f"_{n}_added": F.col(f"_{n}_added") + F.coalesce(f"total_{n}", F.lit(0)) for n in names},
        }
        moved = cut(moved.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in keep), "is_centre"), "components")
        discard(large, centre, under, table)
        table = moved
        done.append(cut(moved.where("is_centre").select(*keep, F.lit(True).alias("apart")), "taken-centroids"))
        state = moved.where("not is_centre").select(*keep)
    rows = state.select(*keep, F.lit(False).alias("apart"))
    for part in done:
        rows = rows.unionByName(part)
    whole = rows.where("not apart").select(*keep)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema.fields)
    columns = [f"_{n}" for n in names]
    small_ones = map_batches(whole.repartition(*_COMP).sortWithinPartitions(*_COMP), lambda b: _small_components(b, columns), schema)
    rows = small_ones.unionByName(rows.where("apart").select(*keep))
    return rows.select(*nodes.columns, *(F.col(f"_{n}_added").alias(n) for n in names))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conv_id become, for each node, lists of decimal ids with commas, of about PIECE characters."""
    held: list[int] = []
    node, length = None, 0
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*_NODE, "first", "ids"])
        out.clear()
        return batch

    size = 0
    for batch in batches:
        for n1, n2, conv in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "conv_id")), strict=True):
            if held and ((n1, n2) != node or length > PIECE):
                out.append((*node, held[0], ",".join(map(str, held))))
                size += length
                held, length = [], 0
                if size > 1 << 22 or len(out) >= 10_000:
                    yield made()
                    size = 0
            node = n1, n2
            held.append(conv)
            length += 12
    if held:
        out.append((*node, held[0], ",".join(map(str, held))))
    if out:
        yield made()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id become one SHA-256 a node; a node's pieces stream through, never held together."""
    node, state, empty = None, None, True
    for batch in batches:
        out = []
        for n1, n2, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids")), strict=True):
            if (n1, n2) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state, empty = (n1, n2), hashlib.sha256(), True
            state.update(ids.encode() if empty else b"," + ids.encode())
            empty = False
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:2]), pa.array(columns[2], pa.string())], names=[*_NODE, "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])], names=[*_NODE, "ends_sha256"])


def ends(ways: DataFrame) -> DataFrame:
    """n1, n2, ends_sha256: of the conversations that end at a node, the SHA-256 of their ids, ascending, with commas.

    A digest is made in order, so a node's ids go through one task, in pieces of many ids that other tasks have joined.
    """
    last = ways.groupBy("conv_id").agg(F.max(F.struct("depth", *_NODE)).alias("end")).select("conv_id", "end.n1", "end.n2")
    pieces = map_batches(last.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id"), _pieces, "n1 long, n2 long, first long, ids string")
    return map_batches(pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first"), _hashed, "n1 long, n2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a node of the trie.

    See `rebuilt` for the conversations that make it up. conv_id is the smallest member. The root, of depth 0, has every
    conversation as a member and no parent; conversations without turns end there. saved_tokens are the words that a shared
    turn needn't be stored for again, over the subtree. Other columns take no part. No rows, or none with conv_id: none.
    """
    ways = paths(conversations)
    nodes = trie(ways)
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    nodes = rolled_up(cut(nodes, "trie"), ways, {"n_leaves": "leaf", "saved_tokens": "saved"}, small)
    return nodes.join(ends(ways), _NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )

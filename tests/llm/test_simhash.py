import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from barloom.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and root(i) != root(j):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def collect(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_fingerprint_of_parts(monkeypatch):
    text = "The cat É sat\ton THE mat  again and again, " * 50
    whole = simhash.fingerprint(text.encode())
    assert whole == slow_fingerprint(text)
    parts = simhash._word_lists
    monkeypatch.setattr(simhash, "_word_lists", lambda t: parts(t, 7))
    assert simhash.fingerprint(text.encode()) == whole
    assert simhash.fingerprint(b"One Two") == slow_fingerprint("one two")


def test_near_duplicates_against_brute_force(docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 80)))) for i in range(60)]
    for i in range(60):
        words = rows[rng.randrange(5)][1].split() * 4
        words[rng.randrange(len(words))] = "new"
        rows.append((1000 - i, " ".join(words)))
    rows += [(5000, ""), (5001, None), (5002, " \n"), (7, rows[3][1]), (None, rows[4][1]), (None, "all alone here"), (6000, "x" * 50_000)]
    assert collect(simhash.near_duplicates(docs(rows, extra=["fp", "root", "shard"]))) == brute(rows)
    assert simhash.near_duplicates(docs([])).collect() == []


def direct(x, bounds, radius=4):
    forest = simhash.Forest(len(x))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        i, j = np.nonzero(np.bitwise_count(x[a:b, None] ^ x[None, a:b]) <= radius)
        forest.link(a + i, a + j)
    return forest.roots(np.arange(len(x)))


def test_tree_finds_every_pair():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, 1 << 63, 1500, dtype=np.uint64), np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 12, 2000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)) ^ rng.integers(0, 1 << 9, 2000, dtype=np.uint64)])
    rng.shuffle(x)
    for bounds in ([0, len(x)], [0, 1, 3, 3, 700, 702, 2000, len(x)], [0]):
        some, bounds = x[: bounds[-1]], np.array(bounds)
        for step in (1 << 20, 50):
            if step == 50 and len(some) and len(bounds) == 2:
                continue
            forest = simhash.Forest(len(some))
            pairs, compared = simhash.tree_links(some, bounds, forest, step=step)
            assert (forest.roots(np.arange(len(some))) == direct(some, bounds)).all()
            assert pairs == sum(n * (n - 1) // 2 for n in np.diff(bounds)) and (compared < 0.7 * pairs or not pairs)


def test_large_shards_are_split(spark):
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 12, 600, dtype=np.uint64) << np.uint64(3) | rng.integers(0, 2, 600, dtype=np.uint64) << np.uint64(40))
    points = spark.createDataFrame([(int(v),) for v in x], "fp long")
    roots = x[direct(x, [0, len(x)])]
    want = {(int(a), int(b)) for a, b in zip(x, roots, strict=True) if a != b}
    got = {(r["node"], r["root"]) for r in simhash.components(simhash.links(points, max_shard=40, rounds=2)).collect() if r["node"] != r["root"]}
    assert got == want
    done = simhash.work(points).first()
    assert 0 < done["compared"] < done["pairs"]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000 + i, 100) for i in range(40)]
    got = simhash.components(spark.createDataFrame(chain + star, "a long, b long")).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert {(r["root"], r["n"]) for r in got} == {(0, 40), (100, 40)}


def test_keep_one(docs):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, "something else here now ok"), (None, "a b c d e"), (1, "a b c d e"), (3, "quite another text of its own"), (None, "alone alone again and again"), (None, "alone alone again and again"), (4, "quite another text of its own")]
    for extra in ((), ("_gone", "_gone_id", "_gone_digest", "_nth", "fp", "digest")):
        df = docs(rows, extra=extra)
        out = simhash.keep_one(df)
        assert out.columns == df.columns
        assert sorted(((r["doc_id"], r["text"][:5]) for r in out.collect()), key=str) == [(1, "a b c"), (3, "quite"), (3, "somet"), (None, "alone")]

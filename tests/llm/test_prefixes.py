import hashlib
import random
import zlib

import duckdb
import pytest

from barloom.llm import prefixes
from barloom.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth string, `a.b` string, n1 long"


def by_hand(rows):
    """The trie's rows, from dictionaries."""
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = f"{len(role)}:{role}{text}"
            turns.setdefault(c, []).append(((t is not None, t or 0), hashlib.md5(said.encode()).hexdigest(), said, len([w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w])))
    turns = {c: sorted(ts, key=lambda x: x[:2]) for c, ts in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - int(__import__("math").fmod(c, 20))
        made[c] = [(x[2], x[3]) for x in turns.get(family, [])[:h] + own[h:]]
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(s for s, _ in seq[:d]), []).append((c, seq[d - 1][1] if d else 0, len(seq) == d))
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        children = lambda k: [x for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k]
        here = sorted(c for c, _, end in members if end)
        out.append(
            (
                min(c for c, _, _ in members), len(key), min(c for c, _, _ in nodes[key[:-1]]) if key else None, len(members), len(children(key)),
                sum(not children(k) for k in below), sum((len(nodes[k]) - 1) * nodes[k][0][1] for k in below), hashlib.sha256(",".join(map(str, here)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", "x", 5) for r in rows], SCHEMA)
    return sorted(map(tuple, prefixes.prefix_trie(df, **options).collect()), key=str)


def drawn(seed, n, deep=6, words=("a", "b b", "")):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c, t, draw.choice(["user", "bot"]), draw.choice(words)) for t in range(draw.randint(0, deep))]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [10_000, 12])
def test_against_dictionaries(spark, small):
    rows = drawn(small, 45)
    assert got(spark, rows, small=small) == by_hand(rows)


def test_nulls_ties_repeats_and_no_rows(spark):
    rows = [(None, 0, "u", "x"), (0, None, None, None), (0, None, "u", "z z"), (0, None, "u", "z z"), (0, 5, "u", " \t"), (3, 1, None, "q"), (3, 1, "u", None), (7, 1, "u", "only"), (-25, 0, "u", "neg"), (-20, 0, "u", "n1"), (-20, 1, "u", "n2")]
    rows += [(40 + k, t, "u", f"w{t} w") for k in range(30) for t in range(4)]
    for small in (10_000, 3):
        assert got(spark, rows, small=small) == by_hand(rows)
    assert got(spark, []) == [] and got(spark, [(None, 1, "u", "x")]) == []
    assert got(spark, [(21, 0, "u", "gone")]) == by_hand([(21, 0, "u", "gone")])  # turnless or not


def test_long_conversations_and_texts_over_many_partitions(spark):
    rows = [(c, t, "user", f"turn {t if t < 150 + c else (t, c)}") for c in range(0, 8) for t in range(220)] + [(60, 0, "u", "long " * 50_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        some = got(spark, rows, small=100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert some == by_hand(rows)


def test_many_members_end_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 50)
    rows = [(c, t, "u", f"same {t}") for c in range(0, 400) for t in range(4)]
    ways = prefixes.paths(spark.createDataFrame([(*r, "", "", 0) for r in rows], SCHEMA))
    digests = {r["ends_sha256"] for r in prefixes.ends(ways.repartition(7)).collect()}
    assert digests == {hashlib.sha256(",".join(map(str, range(400))).encode()).hexdigest()}


def test_taking_apart():
    draw = random.Random(5)
    for n in (1, 2, 50, 400):
        for reach in (1, 3, 1000):
            parent = [-1] + [draw.randrange(max(0, v - reach), v) if draw.random() < 0.97 else -1 for v in range(1, n)]
            value, extra = [draw.randrange(9) for _ in parent], [draw.randrange(3) for _ in parent]
            want, sizes = value.copy(), [1] * n
            for v in range(n - 1, -1, -1):
                if parent[v] >= 0:
                    want[parent[v]] += want[v]
                    sizes[parent[v]] += sizes[v]
            added = [extra.copy()]
            prefixes._taken_apart(parent, sizes, [value], added)
            assert added[0] == [w + e for w, e in zip(want, extra, strict=True)]


def test_query_and_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = duck.execute(ORACLES["op11_prefix_trie"])
    names = [d[0] for d in want.description]
    assert sorted(want.fetchall(), key=str) == sorted(map(tuple, QUERIES["op11_prefix_trie"](spark, sf).select(*names).collect()), key=str)

import hashlib
import random

from barloom.llm import substring


def brute(rows, span=substring.SPAN):
    """doc_id -> (n_words, n_removed, digest), by the definition."""
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    seen, out = {}, {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - span + 1):
            w = tuple(words[p : p + span])
            if seen.setdefault(w, (doc_id, p)) != (doc_id, p):
                gone[p : p + span] = [True] * span
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def collect(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def planted(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "é,", "of"] * 40
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, other = say(60), say(25)
    rows = [(i, say(rng.randint(1, 120))) for i in range(40)]
    rows += [(100 + i, f"{say(rng.randint(0, 30))}\n{passage[: rng.randint(120, 300)]}\t{say(10)}") for i in range(30)]
    rows += [(200 + i, f"{say(5)} {other} {say(3)} {other}") for i in range(4)]
    rows += [(300 + i, rows[5][1] if i % 2 else rows[45][1]) for i in range(12)]
    rows += [(400, "a " * 500), (401, "a " * 19), (402, "a b " * 15), (403, ""), (404, None), (405, " \n\t"), (-7, passage), (406, say(20)), (407, say(5000) + " " + passage)]
    return rows


def test_repeats_against_brute_force(docs):
    rows = planted()
    assert collect(substring.repeats(docs(rows, extra=["h", "pos", "marks", "digest"]))) == brute(rows)


def test_fixture_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert collect(substring.repeats(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_shuffled_joins_agree(docs, monkeypatch):
    rows = planted(2)
    monkeypatch.setattr(substring, "BROADCAST_ROWS", -1)
    assert collect(substring.repeats(docs(rows))) == brute(rows)


def test_null_ids_repeated_rows_and_no_rows(docs):
    text = " ".join(map(str, range(30)))
    got = [(r["doc_id"], r["n_removed"]) for r in substring.repeats(docs([(1, text), (1, text), (None, text), (2, text)])).collect()]
    assert sorted(got, key=str) == [(1, 0), (1, 0), (2, 30), (None, 0)]
    assert substring.repeats(docs([])).collect() == []


def test_one_id_with_several_texts(docs):
    first, second = " ".join(map(str, range(30))), " ".join(map(str, range(100, 125)))
    rows = [(1, first), (1, second), (1, second), (2, second + " x"), (3, "y " + first), (None, first)]
    df = docs(rows)
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.repeats(df).collect()]
    assert sorted(got, key=str) == [(1, 25, 0), (1, 25, 0), (1, 30, 0), (2, 26, 25), (3, 31, 30), (None, 30, 0)]
    assert sorted((str(r["doc_id"]), r["text"]) for r in substring.remove_repeats(df).collect()) == sorted([("1", first), ("1", second), ("1", second), ("2", "x"), ("3", "y"), ("None", first)])
    # The longer text of one id may repeat the shorter one: the later by hash loses, and only that.
    both = [r["n_removed"] for r in substring.repeats(docs([(1, first), (1, f"{first} and more")])).collect()]
    assert sorted(both) == [0, 30]


def test_removal_from_texts(docs, monkeypatch):
    text = " ".join(map(str, range(30)))
    rows = [(1, text), (2, f"x  y\n{text} z"), (3, "a  b")]
    df = docs(rows, extra=["spans", "_spans", "_of_doc_id", "th"])
    for limit in (substring.BROADCAST_SPANS, -1):
        monkeypatch.setattr(substring, "BROADCAST_SPANS", limit)
        out = substring.remove_repeats(df)
        assert out.columns == df.columns
        assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: text, 2: "x y z", 3: "a  b"}

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import langid


def slow_bits(training, text, order=langid.ORDER):
    """Code length by method C with exclusions, from dictionaries."""
    out = []
    for lang in sorted(training):
        counts = {}
        for t in training[lang]:
            p = bytes([langid.PAD]) * order + t
            for i in range(order, len(p)):
                for k in range(order + 1):
                    counts.setdefault(p[i - k : i], Counter())[p[i]] += 1
        def chance(context, byte):
            if context is None:
                return 1 / 256
            shorter = context[1:] if context else None
            c = counts.get(context, Counter())
            if not c:
                return chance(shorter, byte)
            n, d = sum(c.values()), len(c)
            if byte in c:
                return c[byte] / (n + d)
            left = 1 - sum(chance(shorter, b) for b in c)
            return d / (n + d) * chance(shorter, byte) / left

        p, bits = bytes([langid.PAD]) * order + text, 0.0
        for i in range(order, len(p)):
            bits -= math.log2(chance(p[i - order : i], p[i]))
        out.append(bits)
    return out


@pytest.fixture(scope="module")
def training():
    return {"a": [b"the cat sat on the mat", b"that hat"], "b": ["été à la mer".encode(), b"la la la"]}


def model_of(training, order=langid.ORDER):
    grams = Counter()
    for lang, texts in training.items():
        for t in texts:
            p = bytes([langid.PAD]) * order + t
            for i in range(len(t)):
                grams[lang, int.from_bytes(p[i : i + order + 1], "big")] += 1
    return langid.Model(np.array([a for a, _ in grams], object), np.array([g for _, g in grams], np.int64), np.array(list(grams.values()), np.int64))


def test_code_lengths_against_dictionaries(training, monkeypatch):
    model = model_of(training)
    texts = [b"the hat", "là-bas été".encode(), b"", b"\x01\x02zz the", b"cat", b"that la mer the mat " * 3]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = np.array([slow_bits(training, t) for t in texts])
    assert np.allclose(model.code_lengths(data, at), want, rtol=1e-5)
    monkeypatch.setattr(langid, "_STEP", 7)
    assert np.allclose(model.code_lengths(data, at), want, rtol=1e-5)
    assert np.allclose(model.code_lengths(data, at[2:5]), want[2:4], rtol=1e-5)


def test_costs_are_a_distribution(training):
    model = model_of(training)
    for context in (b"\n\n\n", b"the", b"zzz", b"la ", b"at\x00"):
        grams = (int.from_bytes(context, "big") << 8) + np.arange(256)
        assert np.allclose(np.exp2(-model.bits(grams.astype(np.uint64)).astype(float)).sum(0), 1, atol=1e-4)


def test_many_languages_keep_their_own_contexts(monkeypatch):
    rng = random.Random(5)
    training = {f"l{k:03}": [" ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(5)).encode()] for k in range(230)}
    model = model_of(training)
    assert len(model.languages) == 230 and len(model.tables) == 29
    some = [training[x][0] for x in ("l000", "l017", "l229")]
    data, at = np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])
    bits = model.code_lengths(data, at)
    assert bits.argmin(1).tolist() == [0, 17, 229]
    few = {x: training[x] for x in ("l000", "l017", "l229")}
    assert np.allclose(bits[:, [0, 17, 229]], [slow_bits(few, t) for t in some], rtol=1e-5)


def test_a_language_of_long_documents_is_learned(docs):
    long = " ".join(["grande", "maison", "été", "rivière"] * 20_000)
    rows = [(i, "the cat and the hat of the house", "en") for i in range(40)] + [(100 + i, long, "fr") for i in range(8)] + [(500, "maison grande été", None)]
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs(rows)).collect()}[500] == "fr"


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.keep_identified(df).count() >= 0.99 * len(rows)


def test_edges(docs):
    rng = random.Random(0)
    say = lambda words: " ".join(rng.choices(words, k=40))
    rows = [(i, say(["the", "and", "of", "cat"]), "en") for i in range(20)] + [(50 + i, say(["été", "la", "mer"]), "fr") for i in range(20)]
    rows += [(100, None), (101, ""), (102, "12 34 !!"), (103, "x" * 300_000), (104, "la mer été", None), (None, "the cat"), (104, "la mer été", None), (105, "日本語の文" * 30, None)]
    df = docs(rows, extra=["held_out", "letters", "score", "_letters", "__letters"])
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(df).collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (104, "fr"), (None, "en"), (3, "en"), (55, "fr")} <= got
    assert langid.identify(df).count() == len(rows)
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns
    assert not {100, 101, 102, 105} & {r["doc_id"] for r in kept.collect()}
    assert kept.where(F.col("doc_id") == 104).count() == 2
    assert langid.identify(docs([])).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs([(1, "abc", None)])).collect()} == {"und"}


def test_settings_of_the_session_stay(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        assert langid.identify(docs([(1, "abc", "en"), (2, "abd", "en")])).count() == 2
        assert spark.conf.get(name) == "10000"
    finally:
        spark.conf.set(name, before)

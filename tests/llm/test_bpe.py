import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

os.environ["TOKENIZERS_PARALLELISM"] = "false"
P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from barloom.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary(open(PATH).read())
ENCODER = bpe.Encoder(VOCABULARY)

HARD = [
    "", " ", "  ", "   ", "\n", "\n\n\n", "a", " a", "  a", "   a b", "a   ", "a \n b", "a\n\n b", "a \n\n\n b", "\t\ta", "a\t b", "a \tb\t\t c", "x  y", "   z ",
    "<|endoftext|>", " <|endoftext|> x", "a<|endoftext|><|endoftext|> b  c", "<|endoftext", "it's we'll I'd 'S don't", "1234 5.6e7", "é ç 日本語 ñandú 😀😀", "a\x1cb \x1c c", "\x85 a", "é",
    "word " * 50, "x" * 33, "y" * 500, "ab" * 3000, "Hello, world!\nNew line.\r\nCR  two", "!!!???***", "  lead", "trail  ", "a​b", "﻿bom",
]


def same(texts):
    ids, n = ENCODER.encode(texts)
    parts = np.split(ids, np.cumsum(n)[:-1]) if len(texts) else []
    for text, got in zip(texts, parts, strict=True):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want, repr(text)
        assert VOCABULARY.spelled(got.astype(np.int64)).tobytes().decode() == LIBRARY.decode(want, skip_special_tokens=False) == text


def test_hard_texts_alone_and_together():
    for text in HARD:
        same([text])
    same(HARD)
    same([" ".join(random.Random(k).choices(HARD, k=6)) for k in range(100)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sS1 \n\t\r.,é日 😀<|>")), max_size=30), max_size=4), st.text(max_size=40))
def test_any_text(texts, other):
    same([*texts, other])


def test_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    same(["one two three four five six", "seven eight  nine"])
    same(["one two", "ten   eleven"])


def test_queries_form(spark, docs, sf):
    rows = [(1, "Hello world"), (2, None), (3, ""), (1, "Hello world"), (None, "x" * 100_000), (5, " a  b\n")]
    df = docs(rows, extra=["ids", "decoded"])
    out = bpe.digests(bpe.encode(df, PATH, decoded=True)).collect()
    want = []
    for doc_id, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert bpe.encode(docs([]), PATH).collect() == []
    table = spark.read.parquet(f"{sf}/documents.parquet")
    encoded = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.decode(bpe.encode(table, PATH), PATH).collect()}
    for r in table.collect():
        assert encoded[r["doc_id"]] == (LIBRARY.encode(r["text"], add_special_tokens=False).ids, r["text"])


def test_decoding_broken_sequences(spark):
    df = spark.createDataFrame([(1, [164, 101]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, PATH).collect()}
    assert got == {1: LIBRARY.decode([164, 101], skip_special_tokens=False), 2: "", 3: None}


def test_other_specials_and_files_of_another_kind():
    import json

    data = json.loads(open(PATH).read())
    data["added_tokens"].append({"id": 50257, "content": "[[end]]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    text = json.dumps(data)
    library, encoder = Tokenizer.from_str(text), bpe.Encoder(bpe.Vocabulary(bpe.checked(text)))
    for t in ("a [[end]] b", "[[end]][[end]]", "[[en d]] <|endoftext|>", "plain  text"):
        assert encoder.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        bpe.checked(open(P.path("word_bpe_49k.json")).read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"added_tokens": [data["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.checked(json.dumps(data | change))

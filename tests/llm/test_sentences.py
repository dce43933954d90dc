import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")

from barloom.llm import sentences  # noqa: E402

PATH = P.path("piece_bpe_32k.model")
DATA = open(PATH, "rb").read()
LIBRARY = spm.SentencePieceProcessor(model_file=PATH)
ENCODER = sentences.Encoder(sentences.Model(DATA))

HARD = [
    "", " ", "  ", "a", " a", "a ", "  a   b  ", "\n", "a\n\nb", " \n b", "▁", "▁▁ a", "a▁b", " " * 40 + "x" + " " * 7, "日本語テスト", "😀😀 ñ", "x" * 500, "ab" * 3000, "<s>", "</s> <0x0A>",
    "\t\ta", "\x00b", "é", "é", "don't 12345.67", "\r\n x", "<unk>", "word " * 50, "﻿bom", "ｱ① ½ ﬁ Å",
]


def same(texts, library=LIBRARY, encoder=ENCODER):
    ids, n, begins, ends = encoder.encode(texts)
    cut = np.cumsum(n)[:-1]
    spelled = encoder.model.spelled(ids, n).to_pylist()
    for text, i, b, e, s in zip(texts, np.split(ids, cut), np.split(begins, cut), np.split(ends, cut), spelled, strict=True):
        want = library.encode(text, return_type="proto")
        assert i.tolist() == [p.id for p in want.pieces], repr(text)
        assert list(zip(b.tolist(), e.tolist(), strict=True)) == [(p.begin, p.end) for p in want.pieces], repr(text)
        assert s == library.decode(i.tolist()), repr(text)


def test_hard_texts_alone_and_together():
    for text in HARD:
        same([text])
    same(HARD)
    same([" ".join(random.Random(k).choices(HARD, k=5)) for k in range(60)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sS1 \n\t\r.,é日 😀<|>▁ ")), max_size=30), max_size=4), st.text(max_size=40))
def test_any_text(texts, other):
    same([*texts, other])


def test_forgetting(monkeypatch):
    monkeypatch.setattr(sentences, "REMEMBER", 3)
    same(["one two three four five six", "seven eight  nine"])
    same(["one two", "ten   eleven"])


@pytest.mark.parametrize(("rule", "squeeze", "dummy"), [("nmt_nfkc", True, True), ("nmt_nfkc", False, True), ("nfkc_cf", True, False)])
def test_character_maps(rule, squeeze, dummy):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model, rules = pb.ModelProto.FromString(DATA), pb.ModelProto.FromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.CopyFrom(rules.normalizer_spec)
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.escape_whitespaces = squeeze, dummy, True
    data = model.SerializeToString()
    library, encoder = spm.SentencePieceProcessor(model_proto=data), sentences.Encoder(sentences.Model(data))
    draw, letters = random.Random(7), [*"ab'sS1 \n\t\r.,é日ｱ①  ½ﬁÅA", "the ", "é", "́", "　", "ｶﾞ", "​", "…"]
    for text in HARD + ["".join(draw.choices(letters, k=draw.randint(0, 20))) for _ in range(300)]:
        same([text], library, encoder)


def test_files_of_another_kind():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    for change in ("unigram", "suffix", "fallback", "user"):
        model = pb.ModelProto.FromString(DATA)
        if change == "unigram":
            model.trainer_spec.model_type = 1
        elif change == "suffix":
            model.trainer_spec.treat_whitespace_as_suffix = True
        elif change == "fallback":
            model.trainer_spec.byte_fallback = False
        else:
            model.pieces[500].type = 4
        with pytest.raises(ValueError, match="another kind"):
            sentences.Model(model.SerializeToString())


def test_decoding_any_ids(spark):
    draw = random.Random(3)
    rows = [[draw.choice([*range(0, 259), 338, 500, 263]) for _ in range(draw.randint(0, 8))] for _ in range(200)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)] + [(-1, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in sentences.decode(df, PATH).collect()}
    assert got == {-1: None} | {k: LIBRARY.decode(r) for k, r in enumerate(rows)}


def test_queries_form(spark, docs, sf):
    rows = [(1, "Hello world"), (2, None), (3, ""), (1, "Hello world"), (None, "x" * 100_000), (5, " a  b\n")]
    df = docs(rows, extra=["ids", "Begins", "a.b", "tick`s"])
    out = sentences.digests(sentences.encode(df, PATH, decoded=True)).collect()
    want = []
    for doc_id, text in rows:
        ids = LIBRARY.encode(text or "", add_eos=True)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert sentences.encode(docs([]), PATH).collect() == []
    table = spark.read.parquet(f"{sf}/documents.parquet")
    encoded = {r["doc_id"]: r for r in sentences.decode(sentences.encode(table, PATH), PATH).collect()}
    for r in table.collect():
        got, raw = encoded[r["doc_id"]], r["text"].encode()
        assert got["ids"] == LIBRARY.encode(r["text"], add_eos=True) and got["decoded"] == r["text"]
        assert b"".join(raw[a:b] for a, b in zip(got["begins"], got["ends"], strict=True)) == raw

import io
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

os.environ["TOKENIZERS_PARALLELISM"] = "false"
P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from barloom.llm import token_files  # noqa: E402

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = token_files.LibraryEncoder(open(PATH).read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=st.sampled_from(list("aB'sΣσİ \n\t\r.,é́日 😀<|>\x1c\x85")), max_size=30)), max_size=4))
def test_encoder_agrees_with_whole_texts(texts):
    ids, n = ENCODER.encode(texts)
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [k for w in want for k in w]
    assert n.tolist() == [len(w) for w in want]


def test_words_by_merges():
    assert ENCODER.merges is not None
    rng = random.Random(4)
    letters = list("abcdefghijklmnopqrstuvwxyzABCéèçñßÄØŒſµªº")
    words = ["".join(rng.choices(letters, k=rng.randint(1, 12))) + rng.choice(["", ",", ".", "..", "!", "'s"]) for _ in range(4000)] + ["x" * 40, "İx", "The.", "a", ".", ","]
    for k in range(0, len(words), 50):
        text = " ".join(words[k : k + 50])
        assert ENCODER.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_forgetting(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBER", 2)
    for t in ["a <|startoftext|> b<|endoftext|>c", "It's  5 o'clock\n\nΣΑΣ ΣΑΣ.", "x " * 50]:
        assert ENCODER.encode([t])[0].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_file_round_trip(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    rng = np.random.default_rng(0)
    docs = [(k if k % 7 else None, rng.integers(0, 1 << 32, int(n), dtype=np.uint32)) for k, n in enumerate([0, 1, 63, 64, 65, 1000, 5000, 0, 2, 128])]
    out = io.BytesIO()
    writer = token_files.Writer(out)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    at = 0
    for (doc_id, ids), (got_id, start, got) in zip(docs, token_files.read_file(out), strict=True):
        assert (got_id, start, got.tolist()) == (doc_id, at, ids.tolist())
        at += len(ids)
    with pytest.raises(ValueError):
        list(token_files.read_file(io.BytesIO(out.getvalue()[:-1])))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def collect(df):
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in df.collect()), key=lambda r: r[1])


def test_tables(docs, spark, sf, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randint(-50, 10**12), " ".join(rng.choices(["one", "Two", "é", "x" * 900], k=rng.randint(0, 60)))) for _ in range(80)]
    rows += [(None, "nothing"), (5, None), (6, ""), (7, "same"), (7, "same")]
    files = token_files.write_tokens(docs(rows, extra=["ids", "start"]), PATH, f"file://{tmp_path}/tokens", file_ids=200)
    assert files.count() > 5
    assert collect(token_files.read_tokens(files)) == expected(rows)
    assert token_files.read_tokens(token_files.write_tokens(docs([]), PATH)).collect() == []
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert collect(token_files.read_tokens(token_files.write_tokens(table, PATH))) == expected([(r.doc_id, r.text) for r in table.collect()])

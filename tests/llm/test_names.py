"""Extra columns whose names hold dots, backticks or blanks go through every operator that returns a document's columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import bpe, langid, mixing, quality, sentences, simhash, substring, token_files

P = pytest.importorskip("public_tokenizers")
ODD = {"a.b": "1", "tick`s": "2", "two words": "3", "Text.x": "4"}


@pytest.fixture
def odd(docs):
    text = " ".join(f"word{k}" for k in range(40))
    df = docs([(4, "some english words here", "en"), (5, "noch ein deutscher satz", "de"), (6, text), (7, f"x {text}"), (8, None), (8, None)])
    for name, value in ODD.items():
        df = df.withColumn(name, F.lit(value))
    return df


def test_documents_keep_odd_columns(odd):
    outs = {
        "mix": mixing.mix(odd), "copies": mixing.with_copies(odd), "identified": langid.keep_identified(odd), "keep_one": simhash.keep_one(odd), "repeats": substring.remove_repeats(odd),
        "bpe": bpe.decode(bpe.encode(odd, P.path("byte_bpe_50k.json")), P.path("byte_bpe_50k.json"), "c`d.e"), "pieces": sentences.decode(sentences.encode(odd, P.path("piece_bpe_32k.model")), P.path("piece_bpe_32k.model"), "c`d.e"),
    }
    for name, out in outs.items():
        assert set(odd.columns) <= set(out.columns), name
        for row in out.collect():
            assert {c: row[c] for c in ODD} == ODD, name


def test_other_operators_pass_over_odd_columns(odd, spark, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").withColumn("a.b", F.lit(1))
    assert quality.judge(odd, labels).count() == 6
    assert langid.identify(odd).count() == 6 and simhash.near_duplicates(odd).count() == 6 and substring.repeats(odd).count() == 6
    assert token_files.read_tokens(token_files.write_tokens(odd, P.path("word_bpe_49k.json"))).count() == 6
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, "").columns is not None, name

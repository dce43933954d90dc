"""The pipeline stage by stage, each against a brute-force version over what the stage before kept."""

import pytest

from barloom.llm import common, langid

from .test_simhash import brute as simhash_brute
from .test_substring import brute as substring_brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def rows_of(df):
    return df.collect()


def test_stages_against_brute_force(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_dedup", "substring_dedup", "source_mix", "bpe_tokens"]
    stages = dict(corpus_pipeline.STAGES)
    extra = spark.createDataFrame([(10**6, "12 !! 34", "en", "src0", 8), (10**6 + 1, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(extra)

    kept = common.cut(stages["language_id"](spark, docs, sf), "t1")
    rejected = {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in kept.select("doc_id").collect()}
    verdict = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert rejected == {d for d, r in verdict.items() if r["lang_pred"] == "und" or r["bits_per_byte"] > langid.REJECT_BITS}
    assert {10**6, 10**6 + 1} <= rejected and kept.columns == docs.columns

    rows = kept.collect()
    unique = common.cut(stages["simhash_dedup"](spark, kept, sf), "t2")
    assert {r["doc_id"] for r in unique.collect()} == {d for d, _, c in simhash_brute([(r["doc_id"], r["text"]) for r in rows]) if d == c}

    rows = unique.collect()
    cleaned = common.cut(stages["substring_dedup"](spark, unique, sf), "t3")
    want = substring_brute([(r["doc_id"], r["text"]) for r in rows])
    got = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert {d: len(t.split()) for d, t in got.items()} == {d: n - gone for d, (n, gone, _) in want.items()}
    assert all(got[r["doc_id"]] == r["text"] for r in rows if not want[r["doc_id"]][1])

    mixed = common.cut(stages["source_mix"](spark, cleaned, sf), "t4")
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 2").count() == 0

    tokens = stages["bpe_tokens"](spark, mixed, sf)
    assert sorted((r["doc_id"], r["text"]) for r in tokens.collect()) == sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() > 0 and whole.where("size(ids) <> n_tokens").count() == 0

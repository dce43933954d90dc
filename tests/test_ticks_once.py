"""Queries with several steps over bars read the ticks once."""

import pytest

import __spark_entry__ as entry
from barloom.plans import fixtures as fx
from barloom.plans import learning

REDUCTION = ["greedy_decorrelate", "reduction_report", "variance_fallback", "mutual_info", "mi_rank_topk", "anchor_features"]
TRAINING = ["fit_classifiers", "score_classifiers", "trained_class_scores", "model_store", "apply_regressors", "param_samples"]


@pytest.fixture
def ticks_read(spark, sf, monkeypatch):
    """(a counter of the ticks that tasks see, the ticks that there are)."""
    inner, seen = fx.ticks, spark.sparkContext.accumulator(0)

    def counted(spark, sf_dir):
        def each(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        rows = inner(spark, sf_dir)
        return rows.mapInArrow(each, rows.schema)

    monkeypatch.setattr(fx, "ticks", counted)
    return seen, inner(spark, sf).count()


@pytest.mark.parametrize("name", REDUCTION)
def test_reduction_reads_ticks_once(spark, sf, ticks_read, name):
    seen, there = ticks_read
    assert entry.queries()[name](spark, sf).count() > 0
    assert seen.value == there


@pytest.mark.parametrize("name", TRAINING)
def test_training_reads_ticks_once(spark, sf, ticks_read, monkeypatch, name):
    """What is trained doesn't matter here, so nothing is: no classifiers, and no boosted regressions."""
    monkeypatch.setattr(learning.mod, "fit_classifiers", lambda *_, **__: {})
    monkeypatch.setattr(learning.mod, "fit_boosted", lambda *_: {})
    monkeypatch.setattr(learning, "_STORES", {})
    seen, there = ticks_read
    entry.queries()[name](spark, sf).collect()
    assert seen.value == there

"""What happens while last fits run, and on how many parts they run."""

from threading import Event

from barloom.operators import metrics
from barloom.operators import models as mod

from .test_models import FEATURES, sets, settings  # noqa: F401


def test_thresholds_are_found_while_last_fits_run(spark, sets, monkeypatch):  # noqa: F811
    found, waited, parts, make, threshold = Event(), [], [], mod._estimator, mod.threshold_quantile_f1

    def estimator(p, tuning):
        made = make(p, tuning)
        if not tuning:
            inner = made.fit

            def fit(rows):
                parts.append(rows.rdd.getNumPartitions())
                waited.append(found.wait(60))
                return inner(rows)

            made.fit = fit
        return made

    def asked(*args, **kwargs):
        out = threshold(*args, **kwargs)
        found.set()
        return out

    monkeypatch.setattr(mod, "_estimator", estimator)
    monkeypatch.setattr(mod, "threshold_quantile_f1", asked)
    assert set(mod.fit_classifiers(*sets, FEATURES, settings(spark, {"gbt": 1}), ["ticker", "i"])) == {"gbt"}
    assert waited == [True]
    assert parts == [1]  # 240 rows


def test_short_tables_have_the_same_curves(spark):
    rows = [(f"m{k % 2}", (k * 7919 % 101) / 101, int(k * 31 % 7 > 3)) for k in range(500)] + [("flat", 0.5, k % 2) for k in range(9)]
    scores = spark.createDataFrame(rows, "model string, p double, label int")
    for f, name in ((metrics.average_precision, "ap"), (metrics.threshold_quantile_f1, "threshold")):
        a, b = ({r["model"]: round(r[name], 12) for r in f(scores, ["model"], whole=w).collect()} for w in (False, True))
        assert a == b and len(a) == 3

"""Training, the store and the regressions on small frames, against numpy where there is a closed form."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import models as mod
from barloom.operators.reduction import correlations

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(0)
    rows = [(f"t{i % 3}", i, float(x), float(y), int(x + y / 2 + rng.normal() / 2 > 0)) for i, (x, y) in enumerate(rng.normal(size=(240, 2)))]
    df = spark.createDataFrame(rows, "ticker string, i int, a double, b double, label int").cache()
    return df.where("i < 160"), df.where("i >= 160")


def settings(spark, trials):
    groups = spark.createDataFrame([("up", 160, 80)], "target string, n long, pos long")
    return [r.asDict() for r in mod.param_samples(groups, trials).orderBy("model", "trial").collect()]


def test_settings_of_trials(spark):
    rows = settings(spark, mod.TRIALS)
    assert {m: sum(r["model"] == m for r in rows) for m in mod.TRIALS} == mod.TRIALS
    assert all((3 <= r["depth"] <= 5 and r["trees"] == 100) if r["model"] == "gbt" else (6 <= r["depth"] <= 9 and 120 <= r["trees"] <= 240) for r in rows)
    assert all(r["min_leaf"] <= 8 and 1e-4 <= r["reg"] <= 1 and 0.6 <= r["subsample"] <= 1 for r in rows)
    assert rows == settings(spark, mod.TRIALS)


def test_classifiers_thresholds_and_store(spark, sets, tmp_path):
    train, valid = sets
    params = settings(spark, {"gbt": 1, "logistic": 2, "forest": 1, "tree": 1})
    store = mod.ModelStore(spark, f"file://{tmp_path}/store")
    fits = []

    def fit(names):
        fits.append(sorted(names))
        return mod.fit_classifiers(train, valid, FEATURES, [p for p in params if p["model"] in names], ["ticker", "i"])

    assert store.models("up", ["logistic"], fit, "load") == {} and not fits
    found = store.models("up", ["logistic", "tree"], fit)
    again = store.models("up", ["logistic", "tree", "forest", "gbt"], fit)
    assert fits == [["logistic", "tree"], ["forest", "gbt"]] and set(again) == {"logistic", "tree", "forest", "gbt"}
    assert all(0.6 < float(info["valid_ap"]) <= 1 and 0 < float(info["threshold"]) < 1 for _, info in again.values())
    store.models("up", ["tree"], fit, "train")
    latest = {r["model"]: r["version"] for r in store.registry().collect()}
    assert latest == {"logistic": 1, "tree": 2, "forest": 1, "gbt": 1}
    assert store.load("up", "tree")[1]["valid_ap"] == pytest.approx(float(again["tree"][1]["valid_ap"]))
    with pytest.raises(KeyError):
        store.load("down", "tree")
    wanted = spark.createDataFrame([("up", "tree"), ("down", "tree")], "target string, model string")
    assert [tuple(r) for r in store.missing(wanted).collect()] == [("down", "tree")]
    scored = mod.score_all(found, valid, ["logistic", "absent"], ["ticker", "i"])
    assert scored.where("model = 'absent' and p = 0 and pred = 0").count() == 80
    threshold = float(found["logistic"][1]["threshold"])
    assert scored.where("model = 'logistic'").where((F.col("p") >= threshold).cast("int") != F.col("pred")).isEmpty()
    assert mod.fit_classifiers(train.where("label = 1"), valid, FEATURES, params, ["ticker", "i"]) == {}


def test_targets_are_stored_side_by_side(spark, sets, tmp_path):
    train, valid = sets
    found = mod.fit_classifiers(train, valid, FEATURES, settings(spark, {"tree": 1}), ["ticker", "i"])
    store, targets = mod.ModelStore(spark, f"file://{tmp_path}/store"), [f"t{k}" for k in range(6)]
    with ThreadPoolExecutor(6) as pool:
        loaded = list(pool.map(lambda t: store.models(t, ["tree"], lambda names: found), targets))
    assert all(set(x) == {"tree"} for x in loaded)
    assert sorted(r["target"] for r in store.registry().collect()) == targets


def test_kinds_train_beside_each_other(spark, sets, monkeypatch):
    """No kind waits for another: each's first fit begins only when all kinds have begun."""
    meet, inner, begun = Barrier(3, timeout=60), mod._estimator, set()

    def estimator(p, tuning):
        if p["model"] not in begun:
            begun.add(p["model"])
            meet.wait()
        return inner(p, tuning)

    monkeypatch.setattr(mod, "_estimator", estimator)
    found = mod.fit_classifiers(*sets, FEATURES, settings(spark, {"gbt": 1, "forest": 1, "tree": 1}), ["ticker", "i"])
    assert begun == set(found) == {"gbt", "forest", "tree"}


def test_scores_are_kept_by_version_and_date(spark, sets, tmp_path, monkeypatch):
    dated = [df.withColumn("dt", F.expr("date_add(date'2020-01-01', i)")) for df in sets]
    store, held, asked = mod.ModelStore(spark, f"file://{tmp_path}/store"), F.col("i") >= 160, []
    before = {}
    found = mod.fit_classifiers(*dated, FEATURES, settings(spark, {"tree": 1}), ["ticker", "dt"], before=before)
    store.models("up", ["tree"], lambda names: {n: (*found[n], before[n]) for n in names})
    inner = mod.score_classifier
    monkeypatch.setattr(mod, "score_classifier", lambda m, rows, keys: asked.append(rows.count()) or inner(m, rows, keys))
    rows = dated[0].unionByName(dated[1])
    assert store.scores("up", rows.where("i >= 100 and i < 200"), held).count() == 100 and asked == [40, 60]
    every = store.scores("up", rows.where("i >= 100").unionByName(rows.where("i = 120")), held)
    assert every.count() == 140 and asked[2:] == [40, 0]
    want = {**{r["dt"]: r["p"] for r in inner(before["tree"], dated[1], ["dt"]).collect()}, **{r["dt"]: r["p"] for r in inner(found["tree"][0], dated[0], ["dt"]).collect()}}
    assert all(r["version"] == 1 and r["p"] == pytest.approx(want[r["dt"]]) for r in every.collect())
    assert store.scores("down", rows, held).collect() == []
    store.models("up", ["tree"], lambda names: {n: found[n] for n in names}, "train")
    assert {r["version"] for r in store.scores("up", dated[1], held).collect()} == {2} and asked[4:] == [80]


def test_regressions_against_numpy(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mod, "MIN_TRAIN", 40)
    monkeypatch.setattr(mod, "MIN_VALID", 10)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2)) * [1, 50] + [0, 1000]
    group = np.arange(300) % 3
    y = np.where(group == 0, 2 + 3 * x[:, 0] - 0.01 * x[:, 1], np.where(group == 1, x[:, 0] ** 2, rng.normal(size=300)))
    rows = [(f"t{g}", "s", i, float(a), float(b), float(v)) for i, (g, (a, b), v) in enumerate(zip(group, x, y, strict=True))] + [("few", "s", 0, 1.0, 1.0, 1.0), ("t0", "s", 1, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "ticker string, target string, dt int, a double, b double, y double")
    train, valid = df.where("dt < 200"), df.where("dt >= 200")
    tuned = mod.tune_regressors(train, valid, FEATURES, gate=False).cache()
    best = {(r["ticker"], r["model"]): r for r in tuned.collect()}
    assert set(best) == {(t, m) for t in ("t0", "t1", "t2") for m in mod.KINDS}
    assert best["t0", "linear"]["r2"] > 0.99 and best["t1", "quadratic"]["r2"] > 0.99 > best["t1", "linear"]["r2"]
    for (ticker, kind), r in best.items():
        own = [np.array([(a, b, v) for t, _, i, a, b, v in rows if t == ticker and v is not None and (i < 200) == part]) for part in (True, False)]
        terms = lambda m, kind=kind: np.column_stack([np.ones(len(m)), m[:, :2], *([m[:, :2] ** 2] if kind == "quadratic" else [])])
        errors = []
        for config in range(mod.CONFIGS):
            a = terms(own[0])
            scale = np.sqrt((a * a).sum(0))
            penalty = mod._ridge_of(ticker, "s", kind, config) * np.diag([0.0] + [1.0] * (a.shape[1] - 1))
            w = np.linalg.solve((a / scale).T @ (a / scale) + penalty, (a / scale).T @ own[0][:, 2]) / scale
            errors.append(float(np.sqrt(np.mean((terms(own[1]) @ w - own[1][:, 2]) ** 2))))
        assert r["rmse"] == pytest.approx(min(errors), rel=1e-5) and errors[r["config"]] == pytest.approx(min(errors), rel=1e-6)
    gated = {(r["ticker"], r["model"]) for r in mod.tune_regressors(train, valid, FEATURES).collect()}
    assert ("t0", "linear") in gated and gated <= set(best)
    store = mod.ModelStore(spark, f"file://{tmp_path}/store")
    models = mod.fit_regressors(df, FEATURES, tuned)
    store.save_regressors(models)
    store.save_regressors(models.where("ticker = 't1'"))
    kept = store.regressors().select("ticker", "version").distinct().collect()
    assert sorted(tuple(r) for r in kept) == [("t0", 1), ("t1", 2), ("t2", 1)]
    assert mod.apply_regressors(store.regressors(), df.where("dt = 3").select("ticker", "dt", "a", "b"), FEATURES).count() == 2
    assert store.missing_regressors(spark.createDataFrame([("t0", "s", "linear"), ("new", "s", "linear")], "ticker string, target string, model string")).count() == 1


def test_correlations_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)) * [1, 1e6, 1, 0] + [0, 1e9, 5, 7]
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame([("A" if i % 2 else "B", *map(float, r)) for i, r in enumerate(x)], "ticker string, a double, b double, c double, d double").repartition(5)
    got = {(r["ticker"], r["a"], r["b"]): r["r"] for r in correlations(df, list("abcd")).collect()}
    assert len(got) == 12 and all((v is None) == ("d" in k[1:]) for k, v in got.items())
    for t, part in (("A", x[1::2]), ("B", x[::2])):
        for i, j in ((0, 1), (0, 2), (1, 2)):
            want = np.corrcoef(part[:, i], part[:, j])[0, 1] * 250 / 249
            assert got[t, "abcd"[i], "abcd"[j]] == pytest.approx(want, abs=1e-9)


def test_boosted_trees_compete_with_ridges(spark, monkeypatch):
    """Three kinds a group: what is chosen, handed out and replaced by fallbacks, against loops over the forecasts."""
    monkeypatch.setattr(mod, "MIN_TRAIN", 60)
    monkeypatch.setattr(mod, "MIN_VALID", 20)
    rng = np.random.default_rng(3)
    rows = []
    for g, ticker in enumerate(("t0", "t1", "^GSPC", "few")):
        for d in range(150 if ticker != "few" else 20):
            a, b = rng.normal(size=2)
            y = (0.05 * a if g == 0 else 0.1 * np.sign(np.sin(3 * a)) if g == 1 else 5 * rng.normal()) + 0.005 * rng.normal()
            rows += [(d, ticker, t, float(a), float(b), float(y + 0.1 * (t == "best_sale"))) for t in ("best_entry", "best_sale")]
    df = spark.createDataFrame(rows, "dt int, ticker string, target string, a double, b double, y double").repartition(4)
    train, valid, now = df.where("dt < 100"), df.where("dt >= 100 and dt < 145"), df.where("dt >= 145").drop("y")
    boosted = mod.fit_boosted(train, valid, FEATURES)
    assert set(boosted) == {"best_entry", "best_sale"} and all(1 <= info["rounds"] <= mod.ROUNDS for _, _, info in boosted.values())
    forecasts = mod.valid_forecasts(train, valid, FEATURES, {t: (m, i["config"]) for t, (m, _, i) in boosted.items()}).cache()
    said = {}
    for r in forecasts.collect():
        said.setdefault((r["ticker"], r["target"], r["model"], r["config"]), []).append((r["y"], r["pred"]))
    assert {k[:3] for k in said} == {(t, s, m) for t in ("t0", "t1", "^GSPC") for s in boosted for m in (*mod.KINDS, mod.BOOSTED)}
    best = {}
    for (ticker, target, kind, config), pairs in said.items():
        y, p = np.array(pairs).T
        rmse, mae, span, var = np.sqrt(np.mean((y - p) ** 2)), np.mean(np.abs(y - p)), np.ptp(y) + 1e-9, y.var()
        limit = 0.35 if ticker.startswith("^") else 0.25
        if var < 1e-4 or (rmse / span <= limit and mae / span <= 0.2 and 1 - rmse**2 / var >= -1):
            best[ticker, target, kind] = min(best.get((ticker, target, kind), (np.inf, 0)), (rmse, config))
    tuned = mod.tune_regressors(train, valid, FEATURES, forecasts=forecasts).cache()
    got = {(r["ticker"], r["target"], r["model"]): (r["rmse"], r["config"]) for r in tuned.collect()}
    assert set(got) == set(best) and all(got[k] == (pytest.approx(best[k][0], rel=1e-9), best[k][1]) for k in best)
    error = lambda ticker, kind: min(np.sqrt(np.mean(np.diff(np.array(p), axis=1) ** 2)) for k, p in said.items() if k[:3] == (ticker, "best_entry", kind))
    assert error("t1", mod.BOOSTED) < 0.95 * error("t1", "linear") and error("t0", "linear") < error("t0", mod.BOOSTED) and ("t0", "best_entry", "linear") in got
    known = train.unionByName(valid)
    raw = mod.apply_regressors(mod.fit_regressors(known, FEATURES, tuned), now, FEATURES)
    raw = raw.unionByName(mod.apply_boosted({t: (m, i["config"]) for t, (_, m, i) in boosted.items()}, now).select(*raw.columns))
    out = mod.finished_forecasts(raw, forecasts, tuned, known, now).collect()
    with_model = {(t, s) for t, s, _ in best}
    want = {(d, t, s, m) for d in range(145, 150) for t, s, m in best} | {(d, t, s, "smart_fallback_last") for d in range(145, 150) for t in ("t0", "t1", "^GSPC", "few") for s in boosted if (t, s) not in with_model}
    assert {(r["dt"], r["ticker"], r["target"], r["model"]) for r in out} == want and len(out) == len(want)
    assert all((-0.2 <= r["pred_pct"] <= 0.3) if r["target"] == "best_entry" else (0.05 <= r["pred_pct"] <= 0.4) for r in out)
    assert all(r["used_fallback"] == (r["model"] == "smart_fallback_last") for r in out)
    assert mod.fit_boosted(train.limit(0), valid.limit(0), FEATURES) == {}


def test_many_tickers_are_a_number(spark, monkeypatch):
    monkeypatch.setattr(mod, "CATEGORIES", 2)
    rows = [(d, f"t{t}", "s", float(d % 7), float(t), float(d % 7 + t)) for d in range(40) for t in range(5)]
    df = spark.createDataFrame(rows, "dt int, ticker string, target string, a double, b double, y double")
    (early, _, _) = mod.fit_boosted(df.where("dt < 30"), df.where("dt >= 30"), ["a"])["s"]
    said = early.transform(df).agg(F.corr("prediction", "y").alias("r")).first()["r"]
    assert said > 0.95

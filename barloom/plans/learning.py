"""Queries of feature reduction, training and scoring."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..operators import blends as ble
from ..operators import indicators as ind
from ..operators import models as mod
from ..operators import patterns as pat
from ..operators import reduction as red
from ..operators import splits as spl
from ..operators.fill import pct_change, stack_long
from ..operators.metrics import threshold_quantile_f1
from . import fixtures as fx
from .blending import _targets
from .evaluation import _rounded, _split_sql
from .fixtures import bars_daily, on_bars, on_bars_recursive
from .indicators import _CROSSES as CROSSES
from .indicators import _sma as SMA  # noqa: N812
from .panel import _folder
from .patterns import _ALL as PATTERN_COLUMNS
from .patterns import _UNSHIFTED as PATTERNS
from .registry import query

_PAIRS = [(f, s) for f in ind.AVERAGES for s in ind.AVERAGES if f < s]
#: Every feature that the pipeline makes itself: averages, crosses, the change of close, and all patterns' columns.
FEATURES = [*(f"sma_{n}" for n in ind.AVERAGES), *(f"cross_{f}_{s}" for f, s in _PAIRS), "pct_change", *PATTERN_COLUMNS]
#: Decimals of features, so that both engines agree where bins and counts of values hang on them.
DIGITS = 4


def features(spark, sf_dir, bars=None):
    rows = ind.add_crosses(bars_daily(spark, sf_dir) if bars is None else bars).withColumn("pct_change", pct_change())
    rows = pat.all_patterns(rows)
    return rows.select("ticker", "dt", *(F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), DIGITS).alias(c) for c in FEATURES))


_WIDE = (
    f""", favg as (select ticker, dt, {', '.join(f"{SMA("close", n)} as sma_{n}" for n in ind.AVERAGES)}, close / nullif(lag(close) over (partition by ticker order by dt), 0) - 1 as pct_change from bars),
fcross as (with {CROSSES.removeprefix(', ')}), fpat as (with {PATTERNS.removeprefix(', ')}),
wide as (select ticker, dt, {', '.join(f"round(coalesce({c}::double, 0), {DIGITS}) as {c}" for c in FEATURES)} from favg join fcross using (ticker, dt) join fpat using (ticker, dt)),
long as (unpivot wide on {', '.join(FEATURES)} into name feature value value),
stats as (select ticker, feature, count(distinct value) as kinds, var_samp(value) as variance from long group by ticker, feature)"""
)


def _long(spark, sf_dir):
    return stack_long(features(spark, sf_dir), FEATURES)


def _bars(spark, sf_dir):
    """Bars as a table: ticks are read once however many steps of a query start from bars."""
    return cut(bars_daily(spark, sf_dir), "bars")


def _tables(spark, sf_dir):
    """(features, labels) of one table of bars; features are a table too, in as many parts as there are cores."""
    bars = _bars(spark, sf_dir)
    wide = features(spark, sf_dir, bars).repartition(spark.sparkContext.defaultParallelism)
    return cut(wide, "features"), fx.labelled(spark, sf_dir, bars)


@query("drop_constant", on_bars(_WIDE + " select ticker, feature, kinds from stats where kinds > 1"))
def drop_constant(spark, sf_dir):
    return red.drop_constant(red.feature_stats(_long(spark, sf_dir))).select("ticker", "feature", "kinds")


@query("drop_low_variance", on_bars(_WIDE + " select ticker, feature from stats where variance > 1"))
def drop_low_variance(spark, sf_dir):
    return red.drop_low_variance(red.feature_stats(_long(spark, sf_dir)), 1.0).select("ticker", "feature")


@query("discrete_flag", on_bars(_WIDE + " select distinct feature, feature like 'cross_%' or feature like '%pattern' as is_discrete from long"))
def discrete_flag(spark, sf_dir):
    return _long(spark, sf_dir).select("feature", red.discrete(F.col("feature")).alias("is_discrete")).distinct()


_MI = (
    _WIDE
    + fx.LABELLED
    + """, bin as (select *, case when feature like '%pattern' or feature like 'cross_%' then value else floor(percent_rank() over (partition by ticker, feature order by value) * 8) end as x from long),
lab as (select ticker, dt, unnest([{'label': 'u', 'y': target_up}, {'label': 'd', 'y': target_down}]) as l from labelled),
cell as (select bin.ticker, feature, l.label as label, x, l.y as y, count(*) as n from bin join lab on bin.ticker = lab.ticker and bin.dt = lab.dt group by all),
tot as (select *, sum(n) over (partition by ticker, feature, label, x) as nx, sum(n) over (partition by ticker, feature, label, y) as ny, sum(n) over (partition by ticker, feature, label) as na from cell),
one as (select ticker, feature, label, sum(n / na::double * ln(n * na / (nx * ny)::double)) as mi from tot group by all),
mi as (select ticker, feature, round(greatest(max(mi), 0.0), 9) as mi from one group by ticker, feature),
rk as (select *, row_number() over (partition by ticker order by mi desc, feature) as rank, count(*) over (partition by ticker) as nf from mi),
tops as (select ticker, feature, mi, rank from rk where rank <= least(nf, greatest(3, ceil(nf * 0.5))))"""
)


def _mi(wide, labels):
    return red.mutual_info(stack_long(wide, FEATURES), labels, ["target_up", "target_down"])


@query("mutual_info", on_bars(_MI + " select ticker, feature, round(mi, 6) as mi from mi"))
def mutual_info(spark, sf_dir):
    return _rounded(_mi(*_tables(spark, sf_dir)), ["mi"])


@query("mi_rank_topk", on_bars(_MI + " select ticker, feature, rank from tops"))
def mi_rank_topk(spark, sf_dir):
    return red.rank_top(_mi(*_tables(spark, sf_dir)), "mi", 0.5, 3).select("ticker", "feature", "rank")


_ANCHOR = _MI + """, ex as (select ticker, feature, row_number() over (partition by ticker order by feature) as k from stats where (feature like 'pct_change%' or feature like 'sma_%' or feature like 'tri_%' or feature like 'sr_%') and (ticker, feature) not in (select (ticker, feature) from tops)),
anch as (select ticker, feature, rank from tops union all select ticker, feature, (select max(rank) from tops t where t.ticker = ex.ticker) + k from ex)"""


@query("anchor_features", on_bars(_ANCHOR + " select ticker, feature, rank from anch"))
def anchor_features(spark, sf_dir):
    wide, labels = _tables(spark, sf_dir)
    return red.with_anchors(red.rank_top(_mi(wide, labels), "mi", 0.5, 3), red.feature_stats(stack_long(wide, FEATURES)))


@query("variance_fallback", on_bars(_MI + ", flat as (select ticker, max(mi) <= 0 as flat from mi group by ticker) select stats.ticker, stats.feature, round(case when coalesce(flat, true) then coalesce(variance, 0.0) else coalesce(mi, 0.0) end, 4) as score, coalesce(flat, true) as by_variance from stats left join mi using (ticker, feature) left join flat using (ticker)"))
def variance_fallback(spark, sf_dir):
    wide, labels = _tables(spark, sf_dir)
    return _rounded(red.variance_fallback(_mi(wide, labels), red.feature_stats(stack_long(wide, FEATURES))), ["score"], 4)


_COR = """, cors as (select x.ticker, x.feature as a, y.feature as b, case when var_pop(x.value) > 0 and var_pop(y.value) > 0 then corr(x.value, y.value) * count(*) / (count(*) - 1) end as r
  from (select *, list_position(%s, feature) as k from long) x join (select *, list_position(%s, feature) as k from long) y on x.ticker = y.ticker and x.dt = y.dt and x.k < y.k group by x.ticker, x.feature, y.feature)""" % ((repr(FEATURES),) * 2)


@query("feature_corr", on_bars(_WIDE + _COR + f" select ticker, a, b, round(r, {DIGITS}) as r from cors"))
def feature_corr(spark, sf_dir):
    return _rounded(red.correlations(features(spark, sf_dir), FEATURES), ["r"], DIGITS)


#: Features that correlate as much as this, to four decimals, are alike; at least so many stay.
LIMIT, LEAST = 0.95, 12


def _kept(wide, labels):
    ranked = red.rank_top(_mi(wide, labels), "mi", 0.85, LEAST)
    return red.decorrelated(ranked, _rounded(red.correlations(wide, FEATURES), ["r"], DIGITS), LIMIT, LEAST)


_GREEDY = (
    _MI
    + _COR
    + f""", top85 as (select ticker, feature, rank from rk where rank <= least(nf, greatest({LEAST}, ceil(nf * 0.85)))),
high as (select ticker, feature, list(other) as alike from (select ticker, a as feature, b as other, r from cors union all select ticker, b, a, r from cors) where abs(round(r, {DIGITS})) >= {LIMIT} group by ticker, feature),
todo as (select top85.ticker, top85.feature, top85.rank, coalesce(alike, []) as alike from top85 left join high on high.ticker = top85.ticker and high.feature = top85.feature),
walk as (select ticker, rank, [feature] as kept, []::varchar[] as gone from todo where rank = 1
  union all select t.ticker, t.rank, case when list_has_any(w.kept, t.alike) then w.kept else list_append(w.kept, t.feature) end, case when list_has_any(w.kept, t.alike) then list_append(w.gone, t.feature) else w.gone end
  from walk w join todo t on t.ticker = w.ticker and t.rank = w.rank + 1),
ends as (select ticker, arg_max(kept, rank) as kept, arg_max(gone, rank) as gone from walk group by ticker),
done as (select todo.ticker, feature, rank, list_contains(list_concat(kept, gone[1:greatest(0, {LEAST} - len(kept))]), feature) as kept from todo join ends on ends.ticker = todo.ticker)"""
)


@query("greedy_decorrelate", on_bars_recursive(_GREEDY + " select ticker, feature, rank, kept from done"))
def greedy_decorrelate(spark, sf_dir):
    return _kept(*_tables(spark, sf_dir))


@query("reduction_report", on_bars_recursive(_GREEDY + """, per as (select ticker, count(*) as n from done where kept group by ticker)
select sum(n)::bigint as kept, min(n) as least, quantile_cont(n, 0.5) as median, max(n) as most, (select count(*) from stats) as features, round(100.0 * sum(n) / (select count(*) from stats), 4) as pct from per"""))
def reduction_report(spark, sf_dir):
    wide, labels = _tables(spark, sf_dir)
    return red.reduction_report(_kept(wide, labels).where("kept"), red.feature_stats(stack_long(wide, FEATURES)))


# Training: both targets, every kind of model, the whole budget of trials.

TARGETS = {"up": "target_up", "down": "target_down"}
_STORES: dict[tuple[str, str], mod.ModelStore] = {}


def _labelled_sets(spark, sf_dir, bars):
    """features with both targets and the split of their date."""
    rows = features(spark, sf_dir, bars).join(fx.labelled(spark, sf_dir, bars).select("ticker", "dt", *TARGETS.values()), ["ticker", "dt"])
    return rows.join(F.broadcast(spl.purged_split(bars).select("dt", "split")), "dt")


def _groups(spark, sf_dir, bars):
    """target, n, pos of the rows to tune on."""
    train = fx.labelled(spark, sf_dir, bars).join(F.broadcast(spl.purged_split(bars).where("split = 'train'").select("dt")), "dt", "left_semi")
    both = F.array(*(F.struct(F.lit(t).alias("target"), F.col(c).alias("y")) for t, c in TARGETS.items()))
    return train.select(F.explode(both).alias("t")).groupBy("t.target").agg(F.count("*").alias("n"), F.sum("t.y").alias("pos"))


def _store(spark, sf_dir):
    """The application's store of models of a data set."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = mod.ModelStore(spark, _folder(spark))
    return _STORES[key]


def _models(spark, sf_dir, bars=None):
    """(store, {target: models by name}, rows with their split): trained once an application, and taken from the store after that."""
    bars = _bars(spark, sf_dir) if bars is None else bars
    rows = cut(_labelled_sets(spark, sf_dir, bars), "labelled-sets")
    store = _store(spark, sf_dir)
    params = [r.asDict() for r in mod.param_samples(_groups(spark, sf_dir, bars)).orderBy("target", "model", "trial").collect()]

    def fit(target: str, names: list[str]):
        train, valid = (rows.where(F.col("split") == s).withColumn("label", F.col(TARGETS[target])).select("ticker", "dt", *FEATURES, "label") for s in ("train", "valid"))
        before: dict = {}
        found = mod.fit_classifiers(train, valid, FEATURES, [p for p in params if p["target"] == target and p["model"] in names], ["ticker", "dt"], before=before)
        return {name: (*found[name], before[name]) for name in found}

    kept = lambda t: store.models(t, list(mod.TRIALS), lambda names: fit(t, names))
    with ThreadPoolExecutor(len(TARGETS)) as pool:  # one target's few large fits fill the other's gaps
        models = dict(zip(TARGETS, pool.map(inheritable_thread_target(spark)(kept), TARGETS), strict=True))
    return store, models, rows


_DRAW = lambda name: f"cast('0x' || substr(md5(target || '|' || model || '|' || trial || '|{name}:42'), 1, 13) as bigint) / 4503599627370496.0"
_SPREAD = lambda name, low, high: f"exp(ln({low}) + {_DRAW(name)} * (ln({high}) - ln({low})))"


@query("param_samples", on_bars(_split_sql() + fx.LABELLED + f""", tuned as (select target_up, target_down from labelled where dt in (select dt from calendar where split = 'train')),
groups as (select 'up' as target, count(*) as n, sum(target_up)::bigint as pos from tuned union all select 'down', count(*), sum(target_down)::bigint from tuned),
kinds as (select unnest([{', '.join(f"{{'model': '{m}', 'k': {k}}}" for m, k in mod.TRIALS.items())}]) as m),
drawn as (select target, n, pos, m.model as model, unnest(range(m.k))::int as trial from groups, kinds)
select target, n, pos, model, trial, case when model = 'gbt' then 3 + floor({_DRAW('depth')} * 3) else 6 + floor({_DRAW('depth')} * 4) end::int as depth, case when model = 'gbt' then {mod.ROUNDS} else 120 + 60 * floor({_DRAW('trees')} * 3) end::int as trees, round({_SPREAD('step', 0.03, 0.3)}, 6) as step,
  round(0.6 + 0.4 * {_DRAW('subsample')}, 6) as subsample, greatest(1, least(floor(n / 20), floor({_SPREAD('leaf', 5.0, 80.0)})))::int as min_leaf, round({_SPREAD('reg', 1e-4, 1.0)}, 8) as reg from drawn"""))
def param_samples(spark, sf_dir):
    return mod.param_samples(_groups(spark, sf_dir, _bars(spark, sf_dir)))


@query("fit_classifiers")
def fit_classifiers(spark, sf_dir):
    store, _, _ = _models(spark, sf_dir)
    return store.registry().where(F.col("target").isin(*TARGETS)).select("target", "model", "version", "valid_ap", F.col("params")["threshold"].cast("double").alias("threshold"), "params")


@query("score_classifiers")
def score_classifiers(spark, sf_dir):
    _, models, rows = _models(spark, sf_dir)
    now = rows.where("split = 'apply'")
    up, down = (mod.score_all(models[t], now, list(mod.TRIALS), ["dt", "ticker"]).withColumn("target", F.lit(t)) for t in TARGETS)
    return up.unionByName(down)


@query("trained_class_scores")
def trained_class_scores(spark, sf_dir):
    """dt, ticker, target, p, threshold, pred of the last dates, by trained models.

    Every model's scores come from the store's table, those of valid dates by models that haven't seen them. They are
    calibrated by isotonic fits on valid dates, averaged, and cut where F1 on valid dates is best.
    """
    store, _, rows = _models(spark, sf_dir)
    rows, scores = rows.where("split in ('valid', 'apply')"), None
    for target, label in TARGETS.items():
        part = store.scores(target, rows, F.col("split") == "valid").drop("version").join(rows.select("dt", "ticker", "split", F.col(label).alias("label")), ["dt", "ticker"])
        scores = part if scores is None else scores.unionByName(part)
    scores = cut(scores, "trained-scores")
    valid, now = (scores.where(F.col("split") == s).drop("split") for s in ("valid", "apply"))
    calibrated = cut(ble.isotonic_oof(valid, spl.purged_folds(valid.select("dt").distinct()), apply=now), "calibrated")
    blend = ble.blend_equal(calibrated).join(F.broadcast(scores.select("dt", "split").distinct()), "dt")
    thresholds = threshold_quantile_f1(blend.where("split = 'valid'"), ["target"])
    last = blend.where("split = 'apply'").join(F.broadcast(thresholds), "target")
    return last.select("dt", "ticker", "target", "p", "threshold", (F.col("p") >= F.col("threshold")).cast("int").alias("pred"))


@query("model_store")
def model_store(spark, sf_dir):
    """Every (target, model, ticker) that is stored, pipelines and regressions, with its version and what it says of the last dates."""
    bars = _bars(spark, sf_dir)
    with ThreadPoolExecutor(1) as pool:  # the regressions train beside the classifiers
        beside = None if _store(spark, sf_dir).regressors().take(1) else pool.submit(inheritable_thread_target(spark)(_regressions), spark, sf_dir, bars)
        store, models, _ = _models(spark, sf_dir, bars)
    if beside is not None:
        rows, boosted, _, tuned = beside.result()
        store.save_regressors(mod.fit_regressors(rows.where("split in ('train', 'valid')"), FEATURES, tuned))
        for target, (_, final, info) in boosted.items():
            store.save(target, mod.BOOSTED, final, info)
    pipelines = store.registry().select(F.lit(None).cast("string").alias("ticker"), "target", "model", "version", F.lit(None).cast("int").alias("config"))
    wanted = store.missing(spark.createDataFrame([(t, m) for t in TARGETS for m in mod.TRIALS], "target string, model string"))
    return pipelines.unionByName(store.regressors().select("ticker", "target", "model", "version", "config")).join(wanted.agg(F.count("*").alias("left_to_train")), F.lit(True))


def _regressions(spark, sf_dir, bars=None):
    """(rows with every feature, targets and split; boosted models by target; forecasts of valid rows; what is best for each group and kind)."""
    bars = _bars(spark, sf_dir) if bars is None else bars
    rows = features(spark, sf_dir, bars).join(_targets(spark, sf_dir, bars), ["dt", "ticker"])
    rows = rows.join(F.broadcast(spl.purged_split(bars).select("dt", "split")), "dt")
    rows = cut(rows.select("dt", "ticker", "target", "y", "split", *FEATURES), "regression-rows")
    train, valid = rows.where("split = 'train'"), rows.where("split = 'valid'")
    boosted = mod.fit_boosted(train, valid, FEATURES)
    forecasts = cut(mod.valid_forecasts(train, valid, FEATURES, {t: (m, info["config"]) for t, (m, _, info) in boosted.items()}), "valid-forecasts")
    return rows, boosted, forecasts, cut(mod.tune_regressors(train, valid, FEATURES, forecasts=forecasts), "tuned")


@query("fit_regressors_by_ticker")
def fit_regressors_by_ticker(spark, sf_dir):
    """What is fitted for each ticker and target: ridge regressions with their coefficients, and shares in the boosted trees of all tickers."""
    rows, _, _, tuned = _regressions(spark, sf_dir)
    ridge = mod.fit_regressors(rows.where("split in ('train', 'valid')"), FEATURES, tuned)
    return ridge.unionByName(tuned.where(F.col("model") == mod.BOOSTED).select("ticker", "target", "model", "config", "ridge"), allowMissingColumns=True)


@query("apply_regressors")
def apply_regressors(spark, sf_dir):
    """Forecasts of the last dates from every kind that passed: calibrated, drawn to fallbacks, clipped; fallbacks where none did."""
    rows, boosted, forecasts, tuned = _regressions(spark, sf_dir)
    known, now = rows.where("split in ('train', 'valid')"), rows.where("split = 'apply'")
    raw = mod.apply_regressors(mod.fit_regressors(known, FEATURES, tuned), now.drop("y"), FEATURES)
    pooled = mod.apply_boosted({t: (m, info["config"]) for t, (_, m, info) in boosted.items()}, now.drop("y"))
    raw = raw if pooled is None else raw.unionByName(pooled.select(*raw.columns))
    return mod.finished_forecasts(raw, forecasts, tuned, known, now)


@query("regressor_valid_metrics")
def regressor_valid_metrics(spark, sf_dir):
    return _regressions(spark, sf_dir)[3]

"""Queries of calibration, blends, forecasts' quality and the report."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..operators import blends as ble
from ..operators import quality as qua
from ..operators import report as rep
from ..operators import splits as spl
from ..operators.labels import best_entry_sale, normalised
from ..operators.metrics import confusion, rates, regression_metrics, roc_auc, threshold_quantile_f1
from ..sources.bars import write_fallbacks
from . import fixtures as fx
from .evaluation import _FOLDS, REGM, _rounded, _split_sql, curve_sql, folds, quantile_sql
from .fixtures import bars_daily, on_reg, on_scores
from .panel import _folder, price_grid
from .registry import query

TRIALS = 300
MODELS = ["m1", "m2", "m3"]
_VALID = _split_sql(180, 45) + ", vs as (select * from scores where dt in (select dt from calendar where split = 'valid'))"
_MEAN = ", eq as (select dt, ticker, target, round(avg(p), 9) as p, any_value(label) as label from scores group by dt, ticker, target)"


def valid_scores(spark, sf_dir):
    calendar = spl.purged_split(bars_daily(spark, sf_dir), valid=180, min_train=45).where("split = 'valid'")
    return fx.scores_synth(spark, sf_dir).join(F.broadcast(calendar.select("dt")), "dt", "left_semi")


def _tables(spark, sf_dir):
    """The scores of the valid dates, and the folds, each computed once."""
    return cut(valid_scores(spark, sf_dir), "valid-scores"), cut(folds(spark, sf_dir), "folds")


def apply_scores(spark, sf_dir):
    calendar = spl.purged_split(bars_daily(spark, sf_dir), valid=180, min_train=45).where("split = 'apply'")
    return fx.scores_synth(spark, sf_dir).join(F.broadcast(calendar.select("dt")), "dt", "left_semi")


#: The minimax formula of the isotonic fit, over runs of scores whose rates don't rise (no block of one value ends inside one).
_ISOTONIC = (
    _VALID.replace("vs as (", "aps as (select * from scores where dt in (select dt from calendar where split = 'apply')), vs as (")
    + _FOLDS
    + """, ic as (select target, model, fold, p, count(*) as n, sum(label)::bigint as pos from vs join folds using (dt) where role = 'train' group by target, model, fold, p
  union all select target, model, -1, p, count(*), sum(label)::bigint from vs group by target, model, p),
ig as (select target, model, fold from ic group by target, model, fold
  having sum(pos) >= case when fold < 0 then 1 else 20 end and sum(n) - sum(pos) >= case when fold < 0 then 1 else 20 end and sum(n) >= case when fold < 0 then 2 else 2000 end),
iu as (select *, case when pos / n > lag(pos / n) over (partition by target, model, fold order by p) then 1 else 0 end as up from ic semi join ig using (target, model, fold)),
ir as (select *, sum(up) over (partition by target, model, fold order by p) as run from iu),
ib as (select target, model, fold, run, min(p) as low, max(p) as high, sum(n) as n, sum(pos) as pos from ir group by target, model, fold, run),
ik as (select *, row_number() over w as k, sum(n) over w as cn, sum(pos) over w as cp from ib window w as (partition by target, model, fold order by run)),
il as (select a.target, a.model, a.fold, a.k as a, b.k as b, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) as mean from ik a join ik b on a.target = b.target and a.model = b.model and a.fold = b.fold and a.k <= b.k),
im as (select target, model, fold, b as k, min(mean) over (partition by target, model, fold, a order by b desc rows unbounded preceding) as least from il),
iv as (select target, model, fold, k, max(least) as value from im group by target, model, fold, k),
blocks as (select ik.*, value, lead(low) over w as next_low, lead(value) over w as next_value, first_value(value) over w as bottom from ik join iv using (target, model, fold, k) window w as (partition by target, model, fold order by k)),
floors as (select distinct target, model, fold, bottom from blocks),
asked as (select dt, ticker, target, model, p, label, fold from vs join folds using (dt) where role = 'test' union all select dt, ticker, target, model, p, label, -1 from aps),
held as (select asked.* from asked semi join ig using (target, model, fold)),
met as (
  select held.*, blocks.high, blocks.value, blocks.next_low, blocks.next_value, blocks.low as found
  from held asof left join blocks on held.target = blocks.target and held.model = blocks.model and held.fold = blocks.fold and held.p >= blocks.low),
valued as (
  select met.*, case when found is null then bottom when p <= high or next_low is null then value else value + (next_value - value) * (p - high) / (next_low - high) end as fitted
  from met join floors using (target, model, fold)),
latest as (select dt, ticker, target, model, arg_max(fitted, fold) as fitted from valued group by dt, ticker, target, model)
select dt, ticker, target, model, p as raw, round(coalesce(fitted, p), 6) as p, label, fitted is not null as covered
from (select * from vs union all select * from aps) left join latest using (dt, ticker, target, model)"""
)


@query("isotonic_oof", on_scores(_ISOTONIC))
def isotonic_oof(spark, sf_dir):
    return _rounded(ble.isotonic_oof(*_tables(spark, sf_dir), apply=apply_scores(spark, sf_dir)), ["p"])


_COVERAGE = (
    _VALID
    + _FOLDS
    + """, fitted as (select target, model, fold from vs join folds using (dt) where role = 'train' group by target, model, fold having count(*) >= 2000 and sum(label) >= 20 and count(*) - sum(label) >= 20),
reached as (select distinct fitted.target, fitted.model, folds.dt from fitted join folds on fitted.fold = folds.fold where role = 'test')
select vs.target, vs.model, round(100 * avg((reached.dt is not null)::int), 4) as covered_pct from vs left join reached on vs.target = reached.target and vs.model = reached.model and vs.dt = reached.dt group by vs.target, vs.model"""
)


@query("isotonic_coverage", on_scores(_COVERAGE))
def isotonic_coverage(spark, sf_dir):
    rows = ble.isotonic_oof(*_tables(spark, sf_dir))
    return rows.groupBy("target", "model").agg(F.round(100 * F.avg(F.col("covered").cast("int")), 4).alias("covered_pct"))


@query("blend_equal", on_scores(_MEAN + " select * from eq"))
def blend_equal(spark, sf_dir):
    return ble.blend_equal(fx.scores_synth(spark, sf_dir))


def _search_sql(weight: str = "1.0", logit: bool = False) -> str:
    x = "ln(p / (1 - p))" if logit else "p"
    total = "1 / (1 + exp(-sum(round(w * {x}, 12))))" if logit else "sum(round(w * {x}, 12))"
    return (
        _VALID
        + _FOLDS
        + f""", tw as (select trial, model, -ln((cast('0x' || substr(md5(trial || '|' || model || '|42'), 1, 13) as bigint) + 1) / 4503599627370496.0) as e
  from (select unnest(range({TRIALS}))::int as trial), (select unnest(['m1', 'm2', 'm3']) as model)),
weights as (select trial, model, e / sum(e) over (partition by trial) as w from tw),
rw as (select dt, exp(3.0 * (row_number() over (order by dt) - 1) / (count(*) over () - 1 + 1e-9)) as weight from calendar where split = 'valid'),
tried as (select dt, target, trial, round({total.format(x=x)}, 9) as p, any_value(label) as label from vs join weights using (model) group by dt, ticker, target, trial),
tf as (select target, trial, fold, p, label, weight from tried join folds using (dt) join rw using (dt) where role = 'test')"""
        + curve_sql("target, trial, fold", "tf", weight)
        + """, means as (select target, trial, round(avg(ap), 9) as score from ap group by target, trial),
won as (select target, trial, score from (select *, row_number() over (partition by target order by score desc, trial) as n from means) where n = 1)"""
    )


_WON = " select target, trial, round(score, 6) as score, model, round(w, 6) as w from won join weights using (trial)"


def _search(spark, sf_dir, **options):
    return ble.weight_search(*_tables(spark, sf_dir), TRIALS, **options)


@query("blend_weight_search", on_scores(_search_sql() + _WON))
def blend_weight_search(spark, sf_dir):
    return _rounded(_search(spark, sf_dir), ["score", "w"])


@query("blend_weighted", on_scores(_search_sql() + " select dt, ticker, target, round(sum(round(w * p, 12)), 4) as p, any_value(label) as label from scores join won using (target) join weights on weights.trial = won.trial and weights.model = scores.model group by dt, ticker, target"))
def blend_weighted(spark, sf_dir):
    weights = _search(spark, sf_dir).select("target", "model", "w")
    return _rounded(ble.blended(fx.scores_synth(spark, sf_dir), weights), ["p"], 4)


@query("blend_recency", on_scores(_search_sql("weight") + _WON))
def blend_recency(spark, sf_dir):
    calendar = spl.purged_split(bars_daily(spark, sf_dir), valid=180, min_train=45).where("split = 'valid'")
    return _rounded(_search(spark, sf_dir, recency=spl.recency_weights(calendar)), ["score", "w"])


@query("blend_logit", on_scores(_search_sql(logit=True) + _WON))
def blend_logit(spark, sf_dir):
    return _rounded(_search(spark, sf_dir, logit=True), ["score", "w"])


@query("blend_trimmed", on_scores(" select dt, ticker, target, round(list_sort(list(p))[2], 6) as p, any_value(label) as label from scores group by dt, ticker, target"))
def blend_trimmed(spark, sf_dir):
    return _rounded(ble.blend_trimmed(fx.scores_synth(spark, sf_dir)), ["p"])


@query("blend_selection")
def blend_selection(spark, sf_dir):
    rows, parts = _tables(spark, sf_dir)
    found = [(t, m, float(w)) for t in ("down", "up") for m, w in ble.selection(rows, parts, t).items()]
    return spark.createDataFrame(found, "target string, model string, w double")


@query("meta_features", on_scores(""", wide as (select dt, ticker, target, any_value(label) as label, max(p) filter (model = 'm1') as m1, max(p) filter (model = 'm2') as m2, max(p) filter (model = 'm3') as m3 from scores group by dt, ticker, target),
c as (select *, (m1 + m2 + m3) / 3 as mean from wide)
select dt, ticker, target, label, m1, m2, m3, round(mean, 6) as mean, round(sqrt(((m1 - mean) ** 2 + (m2 - mean) ** 2 + (m3 - mean) ** 2) / 3), 6) as std, least(m1, m2, m3) as min, greatest(m1, m2, m3) as max,
  round(greatest(m1, m2, m3) - least(m1, m2, m3), 6) as range, (m1 >= 0.5)::int + (m2 >= 0.5)::int + (m3 >= 0.5)::int as n_high, round(m1 - mean, 6) as m1_c, round(m2 - mean, 6) as m2_c, round(m3 - mean, 6) as m3_c from c"""))
def meta_features(spark, sf_dir):
    return _rounded(ble.meta_features(fx.scores_synth(spark, sf_dir), MODELS), ["mean", "std", "range", "m1_c", "m2_c", "m3_c"])


@query("blend_stack_lr")
def blend_stack_lr(spark, sf_dir):
    return ble.stack_lr(*_tables(spark, sf_dir), apply=apply_scores(spark, sf_dir))


_ENS = """, ens as (select dt, ticker, target, 'ens_equal' as model, round(avg(p), 9) as p, any_value(label) as label from scores group by dt, ticker, target
  union all select dt, ticker, target, 'ens_trimmed', round(list_sort(list(p))[2], 9), any_value(label) from scores group by dt, ticker, target),
ec as (select target, model, count(*) filter (p < 0.5 and label = 0) as tn, count(*) filter (p >= 0.5 and label = 0) as fp, count(*) filter (p < 0.5 and label = 1) as fn, count(*) filter (p >= 0.5 and label = 1) as tp from ens group by target, model),
em as (select *, round(tp / (tp + fp)::double, 6) as precision, round(tp / (tp + fn)::double, 6) as recall, round(2 * tp / (2 * tp + fp + fn)::double, 6) as f1 from ec),
best as (select target, model, precision, recall, f1 from (select *, row_number() over (partition by target order by precision desc, f1 desc, model) as n from em where recall >= 0.2 or (select max(x.recall) from em x where x.target = em.target) < 0.2) where n = 1)"""


def _blends(spark, sf_dir):
    scores = fx.scores_synth(spark, sf_dir)
    return ble.blend_equal(scores).withColumn("model", F.lit("ens_equal")).unionByName(ble.blend_trimmed(scores).withColumn("model", F.lit("ens_trimmed")))


def _ens_metrics(both):
    table = _rounded(rates(confusion(both, ["target", "model"])), ["precision", "recall", "f1"])
    return table.join(roc_auc(both, ["target", "model"]), ["target", "model"])


@query("best_by_precision", on_scores(_ENS + " select * from best"))
def best_by_precision(spark, sf_dir):
    return ble.best_by_precision(_ens_metrics(_blends(spark, sf_dir)), 0.2).select("target", "model", "precision", "recall", "f1")


@query("best_artifact_summary", on_scores(_ENS + quantile_sql("ens", "ens_t") + """, made as (select max(dt) as made from scores)
select best.target, '{"strategy":"' || best.model || '","threshold":' || threshold || ',"precision":' || precision || ',"recall":' || recall || ',"f1":' || f1 || ',"made":"' || strftime(made, '%Y-%m-%d') || '"}' as artifact
from best join ens_t on best.target = ens_t.target and best.model = ens_t.model, made"""))
def best_artifact_summary(spark, sf_dir):
    both = cut(_blends(spark, sf_dir), "blends")
    best = ble.best_by_precision(_ens_metrics(both), 0.2).join(threshold_quantile_f1(both, ["target", "model"]), ["target", "model"])
    made = both.agg(F.max("dt").alias("made"))
    return ble.artifacts(best.join(F.broadcast(made), F.lit(True)).select("target", "model", "threshold", "precision", "recall", "f1", "made"))


# Forecasts of the last dates, and models judged on the rows before them.

_APPLY = ", la as (select distinct dt from bars order by dt desc limit 5), past as (select * from reg where dt not in (select dt from la)), now as (select dt, ticker, target, model, pred from reg where dt in (select dt from la))"
_PASTM = REGM.replace("rm as", "pm as").replace("from reg group", "from past group")
_FB = """, turned as (select *, row_number() over (partition by ticker, target order by dt desc) as back from normed where dt not in (select dt from la)),
fb as (select ticker, target, avg(y) filter (back <= 30) as rolling_mean, arg_max(y, dt) filter (y is not null) as last_pred from turned group by ticker, target)"""
_CAL = """, cal as (select ticker, target, model, case when count(*) < 3 or var_pop(pred) < 1e-8 then 1.0 else least(1.8, greatest(0.2, regr_slope(y, pred))) end as slope,
  case when count(*) < 3 then 0.0 when var_pop(pred) < 1e-8 then avg(y) - avg(pred) else regr_intercept(y, pred) end as intercept from past group by ticker, target, model)"""
_QUAL = """, qs as (select ticker, target, model, avg(abs(y - pred)) / (max(y) - min(y) + 1e-9) as mae_pct, sqrt(avg((y - pred) ** 2)) / (max(y) - min(y) + 1e-9) as rmse_pct,
  case when var_pop(y) * count(*) > 1e-12 then 1 - avg((y - pred) ** 2) / var_pop(y) else 0 end as r2, var_pop(y) < 1e-4 as flat from past group by ticker, target, model),
q1 as (select *, case when r2 < -1 then 0.7 else 1.0 end as a, rmse_pct > 0.25 as b, mae_pct > 0.2 as c from qs),
qual as (select ticker, target, model, 'other' as asset_type, mae_pct, rmse_pct, r2,
  least(1.0, case when flat then 0.8 else greatest(0.0, greatest(0.0, a - case when b then 0.4 else 0 end) - case when c then 0.3 else 0 end) end + case when r2 > 0.3 then 0.2 when r2 > 0 then 0.1 else 0 end) as quality_score,
  flat or not (r2 < -1 or b or c) as is_valid,
  case when flat then 'low variance' else concat_ws(',', case when r2 < -1 then 'r2' end, case when b then 'rmse' end, case when c then 'mae' end) end as reasons from q1)"""
_PRED = """, mixed as (select now.*, least(1.0, greatest(0.2, quality_score)) as alpha, quality_score, slope, intercept, coalesce(last_pred, rolling_mean) as v
  from now join cal using (ticker, target, model) join qual using (ticker, target, model) left join fb using (ticker, target)),
preds as (select dt, ticker, target, model, least(case when target = 'best_entry' then 0.3 else 0.4 end, greatest(case when target = 'best_entry' then -0.2 else 0.05 end,
  case when v is not null then alpha * (pred * slope + intercept) + (1 - alpha) * v else pred * slope + intercept end)) as pred_pct, alpha, quality_score, false as used_fallback from mixed)"""
_BEST = ", ranked as (select *, row_number() over (partition by ticker, target order by rmse, model) as nth from pm), bestm as (select ticker, target, model, mae, rmse, r2 from ranked where nth = 1)"
_ALL = _APPLY + _PASTM + _FB + _CAL + _QUAL + _PRED + _BEST


def _parts(spark, sf_dir, bars=None):
    """(rows before the last dates, forecasts on them, fallbacks, best models); what several of them read is a table."""
    bars = cut(bars_daily(spark, sf_dir), "bars") if bars is None else bars
    rows, last = cut(fx.reg_synth(spark, sf_dir, bars), "forecasts"), bars.select("dt").distinct().orderBy(F.desc("dt")).limit(5)
    past, now = rows.join(F.broadcast(last), "dt", "left_anti"), rows.join(F.broadcast(last), "dt", "left_semi").drop("y")
    targets = _targets(spark, sf_dir, bars).join(F.broadcast(last), "dt", "left_anti")
    best = rep.best_model_per_ticker(regression_metrics(past, qua.MODEL))
    return past, now, qua.fallback_values(targets), best


def _targets(spark, sf_dir, bars=None):
    b = best_entry_sale(bars_daily(spark, sf_dir) if bars is None else bars, fx.HORIZON)
    pairs = F.array(*(F.struct(F.lit(k).alias("target"), normalised(F.col(f"target_{k}"), F.col("close")).alias("y")) for k in ("best_entry", "best_sale")))
    return b.select("dt", "ticker", F.explode(pairs).alias("t")).select("dt", "ticker", "t.*")


def predictions(spark, sf_dir, parts=None):
    past, now, fallbacks, _ = parts or _parts(spark, sf_dir)
    return qua.blend_with_fallback(now, qua.linear_calibration(past), qua.model_quality(past), fallbacks)


@query("fallback_values", on_reg(_APPLY + _FB + " select ticker, target, round(rolling_mean, 6) as rolling_mean, round(last_pred, 6) as last_pred from fb"))
def fallback_values(spark, sf_dir):
    return _rounded(_parts(spark, sf_dir)[2], ["rolling_mean", "last_pred"])


@query("low_variance_tickers", on_reg(" select ticker, target, round(var_samp(y), 6) as variance from normed group by ticker, target having var_samp(y) < 0.1"))
def low_variance_tickers(spark, sf_dir):
    return _rounded(qua.low_variance(_targets(spark, sf_dir), 0.1), ["variance"])


@query("linear_calibration", on_reg(_APPLY + _CAL + " select ticker, target, model, round(slope, 5) as slope, round(intercept, 5) as intercept from cal"))
def linear_calibration(spark, sf_dir):
    return _rounded(qua.linear_calibration(_parts(spark, sf_dir)[0]), ["slope", "intercept"], 5)


@query("model_quality", on_reg(_APPLY + _QUAL + " select ticker, target, model, asset_type, round(mae_pct, 6) as mae_pct, round(rmse_pct, 6) as rmse_pct, round(r2, 6) as r2, round(quality_score, 6) as quality_score, is_valid, reasons from qual"))
def model_quality(spark, sf_dir):
    return _rounded(qua.model_quality(_parts(spark, sf_dir)[0]), ["mae_pct", "rmse_pct", "r2", "quality_score"])


_P = " select dt, ticker, target, model, round(pred_pct, 5) as pred_pct, round(alpha, 5) as alpha, round(quality_score, 5) as quality_score, used_fallback from preds"


@query("blend_with_fallback", on_reg(_ALL + _P))
def blend_with_fallback(spark, sf_dir):
    return _rounded(predictions(spark, sf_dir), ["pred_pct", "alpha", "quality_score"], 5)


@query("quality_filter", on_reg(_ALL + _P + " where quality_score >= 0.7 and not used_fallback"))
def quality_filter(spark, sf_dir):
    return _rounded(qua.quality_filter(predictions(spark, sf_dir)), ["pred_pct", "alpha", "quality_score"], 5)


_SMART = ", smart as (select dt, n.ticker, n.target, least(case when n.target = 'best_entry' then 0.3 else 0.4 end, greatest(case when n.target = 'best_entry' then -0.2 else 0.05 end, coalesce(last_pred, rolling_mean))) as pred_pct from normed n join fb on n.ticker = fb.ticker and n.target = fb.target where dt in (select dt from la) and (n.ticker, n.target) not in (select (ticker, target) from pm where r2 > 0.0))"


@query("smart_fallback_rows", on_reg(_ALL + _SMART + " select dt, ticker, target, 'smart_fallback_last' as model, round(pred_pct, 5) as pred_pct, 0.0::double as alpha, 0.5::double as quality_score, true as used_fallback from smart"))
def smart_fallback_rows(spark, sf_dir):
    past, now, fallbacks, _ = _parts(spark, sf_dir)
    models = regression_metrics(past, qua.MODEL).where("r2 > 0.0")
    last = bars_daily(spark, sf_dir).select("dt").distinct().orderBy(F.desc("dt")).limit(5)
    wanted = _targets(spark, sf_dir).join(F.broadcast(last), "dt", "left_semi").select("dt", "ticker", "target")
    return _rounded(qua.smart_fallback_rows(wanted, models, fallbacks), ["pred_pct"], 5)


@query("fallback_share", on_reg(_ALL + _SMART + ", every as (select quality_score, used_fallback from preds union all select 0.5, true from smart) select count(*) filter (used_fallback) as fallbacks, round(100.0 * count(*) filter (used_fallback) / count(*), 4) as pct, round(avg(quality_score), 6) as mean_quality from every"))
def fallback_share(spark, sf_dir):
    every = predictions(spark, sf_dir).select("quality_score", "used_fallback").unionByName(smart_fallback_rows(spark, sf_dir).select("quality_score", "used_fallback"))
    return every.agg(F.count_if("used_fallback").alias("fallbacks"), F.round(100.0 * F.count_if("used_fallback") / F.count("*"), 4).alias("pct"), F.round(F.avg("quality_score"), 6).alias("mean_quality"))


@query("fallback_sink", on_reg(_APPLY + _FB + " select ticker, target, round(last_pred, 6) as last_pred from fb"))
def fallback_sink(spark, sf_dir):
    path = _folder(spark)
    write_fallbacks(_parts(spark, sf_dir)[2], qua.low_variance(_targets(spark, sf_dir), 0.1), path)
    return spark.read.schema("ticker string, target string, last_pred double").json(f"{path}/fallbacks").withColumn("last_pred", F.round("last_pred", 6))


@query("lowvar_sink", on_reg(" select distinct ticker as value from (select ticker, target from normed group by ticker, target having var_samp(y) < 0.1)"))
def lowvar_sink(spark, sf_dir):
    path = _folder(spark)
    write_fallbacks(_parts(spark, sf_dir)[2], qua.low_variance(_targets(spark, sf_dir), 0.1), path)
    return spark.read.text(f"{path}/low_variance")


# The report.

_PRICE = ", priced as (select preds.*, close * (1 + pred_pct) as pred_price, close from preds join bestm using (ticker, target, model) left join bars using (dt, ticker))"


def _priced(spark, sf_dir, bars=None, parts=None):
    bars = cut(bars_daily(spark, sf_dir), "bars") if bars is None else bars
    parts = parts or _parts(spark, sf_dir, bars)
    rows = rep.join_best(predictions(spark, sf_dir, parts), parts[3])
    prices = bars.select("dt", "ticker", "close")
    return rows.join(prices, ["dt", "ticker"], "left").withColumn("pred_price", F.col("close") * (1 + F.col("pred_pct")))


@query("top_k_per_day", on_scores(_MEAN + " select target, dt, ticker, p, n as rank from (select *, row_number() over (partition by target, dt order by p desc, ticker) as n from eq) where n <= 20"))
def top_k_per_day(spark, sf_dir):
    return rep.top_k_per_day(ble.blend_equal(fx.scores_synth(spark, sf_dir)), by=["target", "dt"]).select("target", "dt", "ticker", "p", "rank")


@query("best_model_per_ticker", on_reg(_APPLY + _PASTM + _BEST + " select ticker, target, model, round(mae, 6) as mae, round(rmse, 6) as rmse, round(r2, 6) as r2 from bestm"))
def best_model_per_ticker(spark, sf_dir):
    return _rounded(_parts(spark, sf_dir)[3], ["mae", "rmse", "r2"])


def _joined(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return rep.join_best(predictions(spark, sf_dir, parts), parts[3])


@query("join_best_model", on_reg(_ALL + " select dt, ticker, target, model, round(pred_pct, 5) as pred_pct from preds join bestm using (ticker, target, model)"))
def join_best_model(spark, sf_dir):
    return _rounded(_joined(spark, sf_dir).select("dt", "ticker", "target", "model", "pred_pct"), ["pred_pct"], 5)


@query("join_close", on_reg(_ALL + _PRICE + " select dt, ticker, target, model, close, round(pred_price, 2) as pred_price from priced"))
def join_close(spark, sf_dir):
    return _rounded(_priced(spark, sf_dir).select("dt", "ticker", "target", "model", "close", "pred_price"), ["pred_price"], 2)


_PIV = ", piv as (select dt, ticker, max(pred_price) filter (target = 'best_entry') as pred_best_entry, max(pred_price) filter (target = 'best_sale') as pred_best_sale from priced group by dt, ticker having max(pred_price) is not null)"


@query("pivot_entry_sale", on_reg(_ALL + _PRICE + _PIV + " select dt, ticker, round(pred_best_entry, 2) as pred_best_entry, round(pred_best_sale, 2) as pred_best_sale from piv"))
def pivot_entry_sale(spark, sf_dir):
    return _rounded(rep.pivot_targets(_priced(spark, sf_dir)), ["pred_best_entry", "pred_best_sale"], 2)


_MBT = ", mbt as (select ticker, max(r2) filter (target = 'best_entry') as r2_entry, max(rmse) filter (target = 'best_entry') as rmse_entry, max(r2) filter (target = 'best_sale') as r2_sale, max(rmse) filter (target = 'best_sale') as rmse_sale from bestm group by ticker)"
_MBT_COLS = ["r2_entry", "rmse_entry", "r2_sale", "rmse_sale"]


@query("attach_best_metrics", on_reg(_APPLY + _PASTM + _BEST + _MBT + " select ticker, " + ", ".join(f"round({c}, 6) as {c}" for c in _MBT_COLS) + " from mbt"))
def attach_best_metrics(spark, sf_dir):
    return _rounded(rep.metrics_by_ticker(_parts(spark, sf_dir)[3]), _MBT_COLS)


_SCORES_ONLY = fx.SCORES
_WIDE = ", wide as (select dt, ticker, max(p) filter (target = 'up') as proba_up, max(p) filter (target = 'down') as proba_down from eq group by dt, ticker)"
_REPORT = (
    _SCORES_ONLY + fx.REG + _ALL + _PRICE + _PIV + _MBT + _MEAN + _WIDE
    + """, prices as (select dt, ticker, close from bars where dt in (select dt from la)),
report as (select prices.dt, prices.ticker, close, proba_up, (proba_up >= 0.5)::int as pred_up, proba_down, (proba_down >= 0.5)::int as pred_down, round(pred_best_entry, 2) as pred_best_entry, round(pred_best_sale, 2) as pred_best_sale,
  round(r2_entry, 6) as r2_entry, round(rmse_entry, 6) as rmse_entry, round(r2_sale, 6) as r2_sale, round(rmse_sale, 6) as rmse_sale
  from prices left join wide using (dt, ticker) left join piv using (dt, ticker) left join mbt using (ticker))"""
)


def report(spark, sf_dir):
    bars = cut(bars_daily(spark, sf_dir), "bars")
    parts = _parts(spark, sf_dir, bars)
    last = bars.select("dt").distinct().orderBy(F.desc("dt")).limit(5)
    prices = bars.join(F.broadcast(last), "dt", "left_semi").select("dt", "ticker", "close")
    classes = rep.class_scores_wide(ble.blend_equal(fx.scores_synth(spark, sf_dir, bars)))
    rows = rep.consolidated(prices, classes, _priced(spark, sf_dir, bars, parts), parts[3])
    return _rounded(_rounded(rows, ["pred_best_entry", "pred_best_sale"], 2), _MBT_COLS)


@query("consolidated_report", fx.on_bars(_REPORT + " select * from report"))
def consolidated_report(spark, sf_dir):
    return report(spark, sf_dir)


@query("join_final", fx.on_bars(_REPORT + " select dt, ticker, close, proba_up, proba_down, pred_best_entry, pred_best_sale from report"))
def join_final(spark, sf_dir):
    return report(spark, sf_dir).select("dt", "ticker", "close", "proba_up", "proba_down", "pred_best_entry", "pred_best_sale")


@query("col_order_final", fx.on_bars(_REPORT + " select * from report order by dt, ticker"))
def col_order_final(spark, sf_dir):
    rows = report(spark, sf_dir)
    return rows.select(*(c for c in rep.REPORT if c in rows.columns)).orderBy("dt", "ticker")


@query("report_stats", fx.on_bars(_REPORT + " select count(*) as rows, min(dt) as first, max(dt) as last, count(distinct ticker) as tickers, round(avg(close), 4) as mean_close, round(avg(r2_entry), 6) as mean_r2_entry, round(avg(rmse_entry), 6) as mean_rmse_entry from report"))
def report_stats(spark, sf_dir):
    return rep.report_stats(report(spark, sf_dir))


@query("model_counts", on_reg(_APPLY + _PASTM + _BEST + " select target, model, count(*) as n, round(count(*) / sum(count(*)) over (partition by target), 6) as share from bestm group by target, model"))
def model_counts(spark, sf_dir):
    return rep.model_counts(_parts(spark, sf_dir)[3])


@query("top10_by_r2", on_reg(_APPLY + _PASTM + _BEST + " select ticker, round(avg(r2), 6) as mean_r2 from bestm group by ticker order by mean_r2 desc, ticker limit 10"))
def top10_by_r2(spark, sf_dir):
    return rep.top_by_r2(_parts(spark, sf_dir)[3])


@query("rows_per_apply_day", on_reg(_ALL + " select dt, count(*) as n, max(max(dt)) over () as last from preds group by dt order by dt desc limit 10"))
def rows_per_apply_day(spark, sf_dir):
    rows = predictions(spark, sf_dir).groupBy("dt").agg(F.count("*").alias("n")).orderBy(F.desc("dt")).limit(10)
    return rows.withColumn("last", F.max("dt").over(W.partitionBy(F.lit(1))))


_NAMES = [f"{k}_{t}__{m}" for t in ("up", "down") for m in MODELS for k in ("proba", "pred")]


@query("apply_wide", on_scores(" select dt, ticker, " + ", ".join(f"max(p) filter (target = '{t}' and model = '{m}') as proba_{t}__{m}, max((p >= 0.5)::int) filter (target = '{t}' and model = '{m}') as pred_{t}__{m}" for t in ("up", "down") for m in MODELS) + " from scores group by dt, ticker"))
def apply_wide(spark, sf_dir):
    keys = [f"{t}__{m}" for t in ("up", "down") for m in MODELS]
    wide = fx.scores_synth(spark, sf_dir).withColumn("key", F.concat_ws("__", "target", "model")).groupBy("dt", "ticker").pivot("key", keys).agg(F.first("p"))
    return wide.select("dt", "ticker", *(c for k in keys for c in (F.col(k).alias(f"proba_{k}"), (F.col(k) >= 0.5).cast("int").alias(f"pred_{k}"))))


@query("price_coverage", fx.on_bars(", d as (select distinct dt from bars order by dt desc limit 5), g as (select ticker, dt from (select distinct ticker from bars) cross join d) select round(avg((close is not null)::int), 6) as coverage from g left join bars using (ticker, dt)"))
def price_coverage(spark, sf_dir):
    return price_grid(spark, sf_dir).agg(F.round(F.avg(F.col("close").isNotNull().cast("int")), 6).alias("coverage"))

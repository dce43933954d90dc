"""Queries of splits, sampling, weights and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as met
from ..operators import splits as spl
from . import fixtures as fx
from .fixtures import bars_daily, on_bars, on_scores
from .registry import query


def _split_sql(valid: int = 90, min_train: int = 0, purge: int = 30) -> str:
    return f""", dates as (select dt, row_number() over (order by dt) - 1 as pos, count(*) over () as n from (select distinct dt from bars)),
c as (select *, n - 5 as pre, cast(round_even(0.9 * (n - 6), 0) as int) as mid from dates),
e as (select *, least(pre, greatest({purge + min_train}, mid - {valid // 2}) + {valid}) as fin from c),
v as (select *, greatest({purge + min_train}, fin - {valid}) as ini from e),
calendar as (select dt, pos, case when pos >= pre then 'apply' when pos >= ini and pos < fin then 'valid' when pos < ini - {purge} then 'train' else 'purged' end as split from v)"""


_FOLDS = """, vd as (select dt, row_number() over (order by dt) - 1 as pos, count(*) over () as n from calendar where split = 'valid'),
starts as (select s, row_number() over (order by s) - 1 as fold from (select unnest(range(30, (select max(n) from vd) - 14, 3)) as s)),
folds as (
  select fold, case when pos >= s and pos < s + 15 then 'test' else 'train' end as role, dt from vd, starts
  where (pos >= s and pos < s + 15) or pos < s - 30)"""


@query("purged_split", on_bars(_split_sql() + " select dt, pos, split from calendar"))
def purged_split(spark, sf_dir):
    return spl.purged_split(bars_daily(spark, sf_dir))


@query("purged_split_blends", on_bars(_split_sql(180, 45) + " select dt, pos, split from calendar"))
def purged_split_blends(spark, sf_dir):
    return spl.purged_split(bars_daily(spark, sf_dir), valid=180, min_train=45)


@query("split_guards", on_bars(_split_sql() + " select count(*) >= 130 as enough_history, max(dt) filter (split = 'train') < min(dt) filter (split = 'valid') and max(dt) filter (split = 'valid') < min(dt) filter (split = 'apply') as ordered from calendar"))
def split_guards(spark, sf_dir):
    return spl.split_guards(spl.purged_split(bars_daily(spark, sf_dir)))


def folds(spark, sf_dir):
    calendar = spl.purged_split(bars_daily(spark, sf_dir), valid=180, min_train=45)
    return spl.purged_folds(calendar.where("split = 'valid'").select("dt"))


@query("purged_rolling_folds", on_bars(_split_sql(180, 45) + _FOLDS + " select * from folds"))
def purged_rolling_folds(spark, sf_dir):
    return folds(spark, sf_dir)


@query("undersample", on_bars(fx.LABELLED + """, r as (select ticker, dt, target_up, md5(ticker || '|' || cast(dt as varchar) || '|42') as draw, sum(target_up) over () as pos from labelled),
k as (select *, row_number() over (partition by target_up order by draw) as nth, least(pos, 1000) as kp from r),
a as (select *, row_number() over (order by draw) as turn from k where nth <= case when target_up = 1 then kp else greatest(1, floor(2.0 * greatest(kp, 1))) end)
select ticker, dt, target_up from a where turn <= 2500"""))
def undersample(spark, sf_dir):
    rows = fx.labelled(spark, sf_dir).select("ticker", "dt", "target_up")
    return spl.undersample(rows, "target_up", ["ticker", "dt"], 2500, 1000, 2.0)


@query("row_gate", on_bars(_split_sql() + " select ticker, count(*) filter (split = 'train') as n_train, count(*) filter (split = 'valid') as n_valid from bars join calendar using (dt) group by ticker having n_train >= 500 and n_valid >= 50"))
def row_gate(spark, sf_dir):
    b = bars_daily(spark, sf_dir)
    return spl.row_gate(b, spl.purged_split(b), ["ticker"])


@query("recency_weight", on_bars(_split_sql() + ", v2 as (select dt, row_number() over (order by dt) - 1 as i, count(*) over () as n from calendar where split = 'valid') select dt, round(exp(3.0 * i / (n - 1 + 1e-9)), 6) as weight from v2"))
def recency_weight(spark, sf_dir):
    calendar = spl.purged_split(bars_daily(spark, sf_dir))
    return spl.recency_weights(calendar.where("split = 'valid'")).select("dt", F.round("weight", 6).alias("weight"))


@query("class_weight", on_bars(fx.LABELLED + " select ticker, dt, round(count(*) over (partition by ticker) / (2.0 * count(*) over (partition by ticker, target_up)), 6) as weight from labelled"))
def class_weight(spark, sf_dir):
    rows = fx.labelled(spark, sf_dir).select("ticker", "dt", "target_up")
    return _rounded(spl.with_class_weight(rows, "target_up", ["ticker"]).select("ticker", "dt", "weight"), ["weight"])


BY = ["target", "model"]
_CONF = ", conf as (select target, model, count(*) filter (p < 0.5 and label = 0) as tn, count(*) filter (p >= 0.5 and label = 0) as fp, count(*) filter (p < 0.5 and label = 1) as fn, count(*) filter (p >= 0.5 and label = 1) as tp from scores group by target, model)"
_RATES = """, rates as (select *, round(case when tp + fp > 0 then tp / (tp + fp)::double else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn)::double else 0 end, 6) as recall,
  round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end, 6) as f1,
  round((case when tp + fn > 0 then tp / (tp + fn)::double else 0 end + case when tn + fp > 0 then tn / (tn + fp)::double else 0 end) / 2, 6) as balanced_acc from conf)"""


def curve_sql(by: str, source: str, weight: str = "1.0") -> str:
    """Common tables pts, curve (running sums from the greatest score down) and ap."""
    return f""", pts as (select {by}, p, sum({weight}) as w, sum({weight} * label) as wp from {source} group by {by}, p),
curve as (select *, sum(w) over d as cw, sum(wp) over d as cp, sum(wp) over (partition by {by}) as pos from pts window d as (partition by {by} order by p desc rows between unbounded preceding and current row)),
ap as (select {by}, sum(case when pos > 0 then wp / pos * cp / cw else 0 end) as ap from curve group by {by})"""


_CURVE = curve_sql("target, model", "scores")
_AUC = ", auc as (select target, model, case when sum(wp) > 0 and sum(w - wp) > 0 then 1 - sum(wp * (cw - cp - (w - wp) + (w - wp) / 2)) / (sum(wp) * sum(w - wp)) end as auc from curve group by target, model)"


@query("confusion", on_scores(_CONF + " select * from conf"))
def confusion(spark, sf_dir):
    return met.confusion(fx.scores_synth(spark, sf_dir), BY)


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("precision_recall_f1_balacc", on_scores(_CONF + _RATES + " select * from rates"))
def precision_recall(spark, sf_dir):
    return _rounded(met.rates(met.confusion(fx.scores_synth(spark, sf_dir), BY)), ["precision", "recall", "f1", "balanced_acc"])


@query("average_precision", on_scores(_CURVE + " select target, model, round(ap, 6) as ap from ap"))
def average_precision(spark, sf_dir):
    return _rounded(met.average_precision(fx.scores_synth(spark, sf_dir), BY), ["ap"])


@query("roc_auc", on_scores(_CURVE + _AUC + " select target, model, round(auc, 6) as auc from auc"))
def roc_auc(spark, sf_dir):
    return _rounded(met.roc_auc(fx.scores_synth(spark, sf_dir), BY), ["auc"])


@query("threshold_pr_f1", on_scores(_CURVE + ", f as (select target, model, p, 2 * cp / (cw + pos) as f1 from curve), r as (select *, row_number() over (partition by target, model order by f1 desc, p) as n from f) select target, model, p as threshold, round(f1, 6) as f1 from r where n = 1"))
def threshold_pr_f1(spark, sf_dir):
    return _rounded(met.threshold_f1(fx.scores_synth(spark, sf_dir), BY), ["f1"])


_QUANT = ", ".join(f"{0.01 + 0.98 * k / 198:.17g}" for k in range(199))


def quantile_sql(source: str, name: str) -> str:
    """A common table `name` of the best threshold among 199 quantiles by target and model of source."""
    return f""", {name}_q as (select target, model, unnest(list_distinct(list_transform(quantile_cont(p, [{_QUANT}]), lambda x: round(x, 9)))) as t, min(p) = max(p) as flat from {source} group by target, model),
{name}_g as (select q.target, q.model, t, flat, count(*) filter (p >= t and label = 1) as tp, count(*) filter (p >= t) as picked, sum(label) as pos from {name}_q q join {source} s on q.target = s.target and q.model = s.model group by all),
{name}_r as (select *, row_number() over (partition by target, model order by 2.0 * tp / nullif(picked + pos, 0) desc, t) as n from {name}_g),
{name} as (select target, model, case when flat then 0.5 else t end as threshold from {name}_r where n = 1)"""


@query("threshold_quantile_f1", on_scores(quantile_sql("scores", "tq") + " select target, model, threshold from tq"))
def threshold_quantile_f1(spark, sf_dir):
    return met.threshold_quantile_f1(fx.scores_synth(spark, sf_dir), BY)


REGM = ", rm as (select ticker, target, model, count(*) as n, avg(abs(y - pred)) as mae, sqrt(avg((y - pred) * (y - pred))) as rmse, case when var_pop(y) * count(*) > 1e-12 then 1 - avg((y - pred) * (y - pred)) / var_pop(y) else 0 end as r2 from reg group by ticker, target, model)"


@query("reg_metrics", fx.on_reg(REGM + " select ticker, target, model, n, round(mae, 6) as mae, round(rmse, 6) as rmse, round(r2, 6) as r2 from rm"))
def reg_metrics(spark, sf_dir):
    return _rounded(met.regression_metrics(fx.reg_synth(spark, sf_dir), ["ticker", "target", "model"]), ["mae", "rmse", "r2"])


@query("metrics_table", on_scores(_CONF + _RATES + _CURVE + _AUC + " select rates.*, round(ap, 6) as ap, round(auc, 6) as auc, 0.5::double as threshold from rates join ap using (target, model) join auc using (target, model)"))
def metrics_table(spark, sf_dir):
    return _rounded(met.metrics_table(fx.scores_synth(spark, sf_dir)), ["precision", "recall", "f1", "balanced_acc", "ap", "auc"])

"""Registered queries against their SQL on DuckDB: a selection, or all of them with TEST_ALL=1."""

import datetime
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from barloom import plans

SELECTED = [
    "flagship_cross_label_rates", "bars_schema_repair", "calendar_align_ffill", "fill_100pct", "stack_long", "ticker_dummies", "numeric_clean", "close_fill_window", "sma_all", "ind_macd", "ind_stoch_rsi", "ind_adx", "ind_aroon",
    "patterns_all", "trendline", "target_first_hit", "target_path_aware", "purged_rolling_folds", "undersample", "average_precision", "roc_auc", "threshold_pr_f1", "blend_trimmed", "meta_features", "best_by_precision",
    "ind_kama", "ind_psar", "ind_stc", "threshold_quantile_f1", "class_weight", "isotonic_coverage", "best_artifact_summary", "quality_filter", "join_best_model", "greedy_decorrelate", "feature_corr", "param_samples",
    "linear_calibration", "model_quality", "smart_fallback_rows", "mutual_info", "anchor_features", "consolidated_report",
]
NAMES = sorted(plans.ORACLES) if os.environ.get("TEST_ALL") else SELECTED


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}" if v else "0"
    if isinstance(v, datetime.datetime | datetime.date):
        return v.isoformat()[:10]
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    want = sorted(tuple(plain(r[order.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect()) == want


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

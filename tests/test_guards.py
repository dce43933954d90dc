import datetime

import pytest

from barloom.operators import guards, quality, splits


def test_columns_and_rows(spark):
    df = spark.range(3)
    assert guards.with_columns_of(df, ["id"]) is df and guards.with_rows(df) is df
    with pytest.raises(ValueError, match="bars lacks dt, close"):
        guards.with_columns_of(df, ["dt", "id", "close"], "bars")
    with pytest.raises(ValueError, match="no rows"):
        guards.with_rows(df.where("id > 5"))


def test_strict_quality_filter(spark):
    rows = spark.createDataFrame([(0.9, True), (0.5, False), (None, False)], "quality_score double, used_fallback boolean")
    assert quality.quality_filter(rows).collect() == []
    assert quality.quality_filter(rows, 0.5, strict=True).count() == 1
    with pytest.raises(ValueError, match="no rows"):
        quality.quality_filter(rows, strict=True)
    with pytest.raises(ValueError, match="lacks used_fallback"):
        quality.quality_filter(rows.drop("used_fallback"), strict=True)


def test_splits_that_cannot_be_used(spark):
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k)
    calendar = splits.purged_split(spark.createDataFrame([(day(k),) for k in range(400)], "dt date"))
    assert guards.usable_split(calendar) is calendar
    with pytest.raises(ValueError, match="fewer than 130 dates"):
        guards.usable_split(calendar.where("pos < 100"))
    turned = calendar.selectExpr("dt", "pos", "case split when 'valid' then 'train' when 'train' then 'valid' else split end as split")
    with pytest.raises(ValueError, match="in order"):
        guards.usable_split(turned)
    with pytest.raises(ValueError, match="in order"):
        guards.usable_split(calendar.where("split <> 'apply'"))

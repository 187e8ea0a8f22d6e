from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import ledgerwake as lw
from ledgerwake.sources.frames import market_panel


def table(spark, cells):
    return spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(t), a, v) for t, a, v in cells], "ts timestamp_ntz, asset string, value double")


@pytest.fixture
def dense():
    return [(t, a, 1.0 + t) for t in range(4) for a in ("b", "a", "c")]


def test_numbers_of_periods_and_assets(spark, dense):
    cells = table(spark, dense)
    rows = market_panel(spark, cells, lw.MarketData(cells, cells)).collect()
    assert sorted((r.t_idx, r.asset_idx, r.asset, r.close, r.funding) for r in rows) == [(t, "abc".index(a), a, 1.0 + t, 0.0) for t in range(4) for a in "abc"]
    ordered = cells.withColumn("asset_order", F.when(F.col("asset") == "c", 0).otherwise(1))  # ties go by name
    rows = market_panel(spark, cells, lw.MarketData(ordered, cells, cells)).collect()
    assert {(r.asset, r.asset_idx) for r in rows} == {("c", 0), ("a", 1), ("b", 2)} and len(rows) == 12


def test_errors_are_those_of_the_contract(spark, dense):
    good = table(spark, dense)
    panel = lambda w, c, x: market_panel(spark, table(spark, w), lw.MarketData(table(spark, c), table(spark, x)))
    with pytest.raises(ValueError, match="same periods and assets; weight differs"):
        panel(dense[1:], dense, dense)
    with pytest.raises(ValueError, match="same periods and assets; exec differs"):
        panel(dense, dense, dense[:-3])
    for bad in (dense[1:], [*dense, dense[0]]):  # a hole in all tables, and a cell that comes twice
        with pytest.raises(ValueError, match="each period must hold each asset once"):
            panel(bad, bad, bad)
    for few in (dense[:6], []):
        with pytest.raises(ValueError, match="at least 3 periods"):
            panel(few, few, few)
    with pytest.raises(ValueError, match="must be floats"):
        market_panel(spark, good, lw.MarketData(good.withColumn("value", F.lit(1)), good))


def test_checking_takes_no_job_of_its_own(spark, dense):
    """The tables are read by the writing of the cells, the cells by that of their index; nothing else runs."""
    cells, tracker = table(spark, dense), spark.sparkContext.statusTracker()
    plans = spark._jsparkSession.sharedState().statusStore()
    before = plans.executionsCount()
    panel = market_panel(spark, cells, lw.MarketData(cells, cells))
    assert plans.executionsCount() - before == 2 and panel.count() == 12 and tracker.getActiveStageIds() == []

"""Zoned markets are cut by the clocks of their own zone, as pandas cuts them."""

import numpy as np
import pandas as pd
import pytest

import ledgerwake as lw
from ledgerwake.functions import zones
from ledgerwake.operators import slicing
from ledgerwake.plans import folds
from ledgerwake.sources.frames import market_panel

ZONES = ["Asia/Tokyo", "America/New_York"]


@pytest.fixture(params=["Europe/Berlin"])
def session_zone(spark, request):
    """A session zone that is neither UTC, in which the other tests run, nor a market's."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def wide(index):
    return pd.DataFrame({"A": 100.0 + np.arange(len(index)), "B": 50.0 + np.arange(len(index)) % 7}, index=index)


def panel_of(spark, frame):
    return market_panel(spark, frame, lw.MarketData(frame, frame))


def instants(panel):
    rows = panel.select("ts").distinct().withColumn("us", zones.F.unix_micros("ts")).collect()
    return sorted(pd.Timestamp(r["us"], unit="us", tz="UTC") for r in rows)


@pytest.mark.parametrize("zone", ZONES)
def test_labels(spark, session_zone, zone):
    # over the night in which New York's clocks go forward, and back
    days, hours = pd.date_range("2024-03-01", periods=30, tz=zone), pd.date_range("2024-11-02", periods=60, freq="h", tz=zone)
    for index, bounds in ((days, [("2024-03-05", "2024-03-07"), ("2024-03-09 12:00", "2024-03-11"), (None, "2024-03-20 00:00")]), (hours, [("2024-11-03", "2024-11-03"), ("2024-11-02 05", "2024-11-04 03:00")])):
        panel = panel_of(spark, wide(index))
        for start, end in bounds:
            got = slicing.sliced(panel, lw.SimConfig(start_period=start, end_period=end))
            want = wide(index).loc[start:end].index
            assert instants(got) == list(want.tz_convert("UTC")), (zone, start, end)
            assert got.agg(zones.F.min("t_idx"), zones.F.max("t_idx")).first()[:] == (0, len(want) - 1)


@pytest.mark.parametrize("zone", ZONES)
@pytest.mark.parametrize("period", ["1ME", "2W", "30D"])
def test_folds(spark, session_zone, zone, period):
    index = pd.date_range("2023-12-31", periods=150, tz=zone)
    stamps = folds.zoned_boundaries(*folds.span_of(panel := panel_of(spark, wide(index))), period)
    assert all(str(t.tz) == zone for t in stamps)
    start = pd.Timestamp(index[0].tz_localize(None)).to_period({"1ME": "M", "1MS": "M", "2W": "W", "30D": "D"}[period]).start_time.tz_localize(zone)
    if period != "2W":  # pandas aligns weeks with the Monday before
        assert stamps == list(pd.date_range(start, index[-1] + pd.Timedelta(days=1), freq=period))
    rows = folds.fold_rows(folds.with_folds(panel, stamps, 3)).orderBy("fold_index").collect()
    edges = [*stamps, pd.Timestamp.max.tz_localize("UTC")]
    own = [index[(index >= a) & (index < b)] for a, b in zip(edges, edges[1:])]
    assert [(r.start_period, r.end_period, r.n_periods) for r in rows] == [(i[0].tz_localize(None), i[-1].tz_localize(None), len(i)) for i in own if len(i) >= 3]


def test_hours_follow_instants_and_dates_follow_clocks(spark, session_zone):
    index = pd.date_range("2024-11-02 20:00", periods=48, freq="h", tz="America/New_York")
    stamps = folds.zoned_boundaries(index[0], index[-1], "6h")
    assert [b - a for a, b in zip(stamps, stamps[1:])] == [pd.Timedelta(hours=6)] * (len(stamps) - 1)
    frame = wide(index)
    result = lw.simulate(weights=frame * 0 + 0.5, market=lw.MarketData(frame, frame), config=lw.SimConfig(freq_rule="1h", compute_signal_diagnostics=False), spark=spark)
    assert result.metric_value("Simulation start date") == index[0].tz_localize(None) and result.metric_value("Simulation end date") == index[-1].tz_localize(None)


def test_a_long_table_may_name_its_zone(spark, session_zone):
    index = pd.date_range("2024-01-01", periods=10, tz="Asia/Tokyo")
    long = spark.createDataFrame([(t.to_pydatetime(), a, 1.0 + k) for k, t in enumerate(index) for a in "AB"], "ts timestamp, asset string, value double")
    panel = market_panel(spark, long, lw.MarketData(long, long, time_zone="Asia/Tokyo"))
    assert zones.zone_of(panel) == "Asia/Tokyo"
    assert instants(slicing.by_label(panel, "2024-01-05", "2024-01-07")) == list(index[4:7].tz_convert("UTC"))
    assert zones.zone_of(market_panel(spark, long, lw.MarketData(long, long))) == session_zone

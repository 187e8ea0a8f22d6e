import math

import numpy as np
import pandas as pd
import pytest

import ledgerwake as lw
from ledgerwake.plans import report


def test_a_long_series_is_told_by_what_its_pixels_show(spark):
    draw = np.random.default_rng(3)
    n, pixels = 20_000, 100
    values = np.cumsum(draw.normal(size=n))
    values[5000:6000] = np.nan
    frame = pd.DataFrame({"run_id": "r", "t_idx": np.arange(n, dtype=np.int32), "x": values})
    series = spark.createDataFrame([(a, int(b), None if math.isnan(c) else float(c)) for a, b, c in frame.itertuples(index=False)], "run_id string, t_idx int, x double")
    got = report.reduced(series, ["x"], pixels).toPandas().sort_values("t_idx")
    assert len(got) <= 4 * pixels and got["t_idx"].is_unique
    for k, own in frame.groupby(frame["t_idx"] * pixels // n):
        kept = got[got["t_idx"].between(own["t_idx"].iloc[0], own["t_idx"].iloc[-1])]
        assert kept["t_idx"].iloc[[0, -1]].tolist() == own["t_idx"].iloc[[0, -1]].tolist()
        if own["x"].notna().any():
            assert (kept["x"].min(), kept["x"].max()) == (own["x"].min(), own["x"].max())
    assert report.reduced(series.limit(300), ["x"], pixels).count() == 300


def test_points_and_quantiles_have_a_bound(spark):
    draw = np.random.default_rng(4)
    rows = spark.createDataFrame(pd.DataFrame({"run_id": "r", "a": draw.normal(size=9000), "b": draw.normal(size=9000)}))
    got = report.reduced_points(rows, "a", "b", 20).toPandas()
    assert 100 < len(got) <= 21 * (report._H + 1) and report.reduced_points(rows.limit(50), "a", "b", 20).count() == 50
    pairs = report.quantile_pairs(rows, "a", 50)
    ordered = np.sort(rows.select("a").toPandas()["a"])
    ranks = [round(k * 8999 / 49) for k in range(50)]
    assert [v for _, v in pairs] == pytest.approx(ordered[ranks].tolist(), abs=1e-9) and [x for x, _ in pairs] == sorted(x for x, _ in pairs)
    assert len(report.quantile_pairs(rows.limit(7), "a", 50)) == 7 and report.quantile_pairs(rows.limit(0), "a") == []


def test_page_has_all_charts(spark, tmp_path):
    draw = np.random.default_rng(1)
    close = pd.DataFrame(100 * np.cumprod(1 + draw.normal(0, 0.02, (60, 12)), axis=0), index=pd.date_range("2024-01-01", periods=60, tz="Asia/Tokyo"), columns=[f"A{k}" for k in range(12)])
    result = lw.simulate(weights=close.pct_change().shift(1), market=lw.MarketData(close, close), config=lw.SimConfig(benchmark_asset="A0"), spark=spark)
    page = lw.tearsheet(sim_result=result, output_path=str(tmp_path / "r.html"))
    for title in ("Equity Curve", "Drawdown (%)", "Rolling Sharpe", "Returns Distribution", "Returns Q-Q Plot", "Transaction Costs", "Active Positions", "Net and Gross Exposure", "Position Concentration", "Signal Directionality", "Alpha Decay", "Per-Asset"):
        assert title in page
    assert "2024-01-01" in page and (tmp_path / "r.html").read_text() == page

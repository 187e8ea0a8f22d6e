from datetime import datetime

import numpy as np
import pandas as pd
import pytest

import ledgerwake as lw
from ledgerwake.plans.folds import boundaries

INDEX = pd.date_range("2024-01-01", periods=120)


@pytest.fixture(scope="module")
def market():
    draw = np.random.default_rng(1)
    close = pd.DataFrame(100 * np.cumprod(1 + draw.normal(0.0005, 0.02, (120, 10)), axis=0), index=INDEX, columns=[f"A{k}" for k in range(10)])
    return lw.MarketData(close, close.shift(1).bfill())


@pytest.fixture(scope="module")
def weights(market):
    return pd.DataFrame(np.random.default_rng(2).normal(0, 0.1, (120, 10)), index=INDEX, columns=market.close_prices.columns)


def test_simulate_and_report(spark, market, weights, tmp_path):
    r = lw.simulate(weights=weights, market=market, config=lw.SimConfig(fee_rate=0.001, benchmark_asset="A0"), spark=spark)
    assert isinstance(r, lw.MetricsAccessor) and len(r.available_metrics()) == 71 and len(r.available_metrics("Risk")) == 6
    rows = r.periods.orderBy("t_idx").toPandas()
    ret = rows["equity"].pct_change().fillna(0)
    assert r.metric_value(lw.MetricKey.ANNUALIZED_VOLATILITY) == pytest.approx(ret.std() * 365**0.5)
    assert r.metric_value("Skewness") == pytest.approx(ret.skew()) and r.metric_value("Kurtosis") == pytest.approx(ret.kurt())
    assert r.metric_value("VaR 95%") == pytest.approx(ret.quantile(0.05))
    forward = market.close_prices.shift(-1) / market.close_prices - 1
    ic = [np.corrcoef(weights.iloc[t], forward.iloc[t])[0, 1] for t in range(119)]
    rank = [np.corrcoef(weights.iloc[t].rank(), forward.iloc[t].rank())[0, 1] for t in range(119)]
    assert r.metric_value("Weight IC mean (next)") == pytest.approx(np.mean(ic)) and r.metric_value("Weight Rank IC mean (next)") == pytest.approx(np.mean(rank))
    assert r.metric_value("no such", default=7) == 7
    page = lw.tearsheet(sim_result=r, output_path=str(tmp_path / "page.html"), smooth_periods=10)
    for title in ("Equity Curve (Cumulative Return %)", "Drawdown (%)", "Signal: Multi-Horizon Decay", "Signal: Per-Asset Breakdown", "Position Concentration (Herfindahl Index)"):
        assert title in page
    assert (tmp_path / "page.html").read_text(encoding="utf-8") == page and "<script" not in page


def test_grid(spark, market, weights):
    found = lw.grid_search(generate_weights=lambda p: weights * p["scale"], param_grids=[{"scale": [0.5, 1.0]}], market=market, spark=spark, objective_metric=lw.MetricKey.TOTAL_RETURN_PCT)
    table = found.table.collect()
    assert [r.param_value for r in table] == [0.5, 1.0]
    assert found.best.objective_value == max(r.objective_value for r in table)
    with pytest.raises(ValueError):
        found.pivot()
    with pytest.raises(KeyError):
        lw.grid_search(generate_weights=lambda p: weights, param_grids=[{"a": [1]}], market=market, spark=spark, objective_metric=lw.Metrics.ALPHA)


def test_bad_inputs(spark, market, weights):
    with pytest.raises(ValueError):
        lw.simulate(weights=weights.rename(columns={"A0": "B0"}), market=market, spark=spark)
    with pytest.raises(TypeError):
        lw.tearsheet()


def test_fold_boundaries():
    at = lambda a, b, *x: [d.strftime("%m-%d") for d in boundaries(datetime(2024, *a), datetime(2024, *b), *x)]
    assert at((1, 5), (8, 20), "3ME") == ["01-31", "04-30", "07-31"]
    assert at((1, 5), (8, 20), "1QE") == ["03-31", "06-30"]
    assert at((1, 5), (1, 20), "1W") == ["01-07", "01-14", "01-21"]
    assert at((1, 5), (3, 20), "30D") == ["01-05", "02-04", "03-05"]
    with pytest.raises(ValueError):
        at((1, 5), (3, 20), "nonsense")


def test_walk_forward(spark, market, weights):
    wf = lw.walk_forward(weights=weights, market=market, fold_config=lw.FoldConfig("1ME"), include_full_result=False, spark=spark, metrics_to_aggregate=["Annualized Sharpe"])
    assert [(f.start_period.strftime("%m-%d"), f.n_periods) for f in wf.folds] == [("01-31", 29), ("02-29", 31), ("03-31", 30)]
    own = wf.metric_aggregation("Annualized Sharpe")
    assert own.count == 3 and own.median == pytest.approx(np.median(own.values)) and own.std == pytest.approx(np.std(own.values, ddof=1))
    with pytest.raises(ValueError):
        wf.metric_value("Annualized Sharpe")
    with pytest.raises(ValueError):
        lw.walk_forward(weights=weights, market=market, fold_config=lw.FoldConfig("1YE"), spark=spark)


def test_series_of_the_signal(spark, market, weights):
    names = ["ic_series", "rank_ic_series", "decile_spread_series", "directionality_series", "forward_return_per_gross_series", "long_hit_rate_series", "short_hit_rate_series", "gross_weight_series"]
    on, off = (lw.simulate(weights=weights, market=market, config=lw.SimConfig(compute_signal_diagnostics=x), spark=spark).artifacts.signal for x in (True, False))
    assert all(getattr(off, name) is None and off.get(name, 7) == 7 for name in names)
    for name in names:
        assert getattr(on, name).columns == ["run_id", "t_idx", "ts", name.removesuffix("_series")]
    gross = [r.gross_weight for r in on.gross_weight_series.orderBy("t_idx").collect()]
    assert gross[:119] == pytest.approx(weights.abs().sum(axis=1).tolist()[:119])


def test_market_tables_must_agree(spark, market, weights):
    close = market.close_prices
    for bad in (weights.iloc[:-1], weights.assign(B=0.0)):
        with pytest.raises(ValueError, match="same periods and assets"):
            lw.simulate(weights=bad, market=market, spark=spark)
    with pytest.raises(ValueError, match="once"):
        lw.simulate(weights=pd.concat([weights, weights.iloc[-1:]]), market=market, spark=spark)
    with pytest.raises(ValueError, match="at least 3"):
        lw.simulate(weights=weights.iloc[:2], market=lw.MarketData(close.iloc[:2], close.iloc[:2]), spark=spark)


def test_synthetic_market(spark):
    from ledgerwake.sources.synthetic import momentum_weights, synthetic_market

    own = synthetic_market(spark, 60, 12)
    close = own.close_prices.toPandas().pivot(index="ts", columns="asset", values="value")
    change = close.pct_change().iloc[1:].to_numpy()
    assert close.shape == (60, 12) and abs(change.std() - 0.02) < 0.002 and abs(change.mean()) < 0.003
    found = lw.grid_search(generate_weights=lambda p: momentum_weights(own.close_prices, p["lookback"], p["power"]), param_grids=[{"lookback": [5, 2], "power": [1.0, 0.5]}], market=own, spark=spark)
    wide = found.pivot().collect()
    assert [r.lookback for r in wide] == [5, 2] and found.pivot().columns == ["lookback", "1.0", "0.5"] and found.top(1).first().objective_value == found.best.objective_value

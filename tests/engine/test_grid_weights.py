import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import ledgerwake as lw
from ledgerwake.plans.grid import Grid, run_table
from ledgerwake.sources.frames import market_panel


def prices(n_assets=7, n=40):
    draw = np.random.default_rng(0)
    return pd.DataFrame(100 * np.cumprod(1 + draw.normal(0.0005, 0.02, (n, n_assets)), axis=0), index=pd.date_range("2024-01-01", periods=n), columns=[f"A{k}" for k in range(n_assets)])


def momentum_function():
    """A function that is sent as it is: workers can't import this module."""

    def momentum(own, params):
        m = own.pct_change(params["lookback"], fill_method=None).fillna(0.0)
        return np.sign(m) * m.abs() ** params.get("power", 1.0)

    return momentum


def test_callable_on_executors_equals_the_driver(spark):
    own = prices()
    market, grids = lw.MarketData(own, own), [{"lookback": [5, 2], "power": [1.0, 0.5]}, {"lookback": [3]}]

    def on_driver(params):
        raw = momentum_function()(own, params)
        return raw.div(raw.abs().sum(axis=1).replace(0.0, np.nan), axis=0).fillna(0.0)

    found = [lw.grid_search(generate_weights=f, param_grids=grids, market=market, spark=spark) for f in (on_driver, lw.ByAsset(momentum_function(), lw.gross_scaled, assets_at_once=3, combinations_at_once=2))]
    a, b = ([[round(x, 9) if isinstance(x, float) else x for x in r] for r in f.table.collect()] for f in found)
    assert a == b and found[1].best.params == found[0].best.params
    assert found[1].table.filter("param1_value > 3").count() == 2 and dict(found[1].table.dtypes)["param2_value"] == "double"
    assert found[1].pivot(grid_index=0).columns == ["lookback", "1.0", "0.5"] and [r["lookback"] for r in found[1].pivot(grid_index=0).collect()] == [5, 2]


def test_a_thousand_combinations_are_one_step_of_the_plan(spark):
    cells = market_panel(spark, prices(5, 10), lw.MarketData(prices(5, 10), prices(5, 10)))
    start = time.time()
    found = lw.ByAsset(momentum_function(), lw.gross_scaled).weights(cells, {f"r{k}": {"lookback": 1 + k % 5, "power": k} for k in range(1000)})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert time.time() - start < 10 and plan.count("FlatMapGroupsInPandas") == 1
    assert found.agg(F.count_distinct("run_id"), F.count(F.lit(1))).first()[:] == (1000, 1000 * 50)


def test_frames_of_another_shape_are_errors(spark):
    with pytest.raises(Exception, match="periods and assets"):
        lw.ByAsset(lambda own, params: own.iloc[1:]).weights(market_panel(spark, prices(2, 5), lw.MarketData(prices(2, 5), prices(2, 5))), {"r": {}}).collect()


def test_kinds_of_parameter_values(spark):
    grids = tuple(map(Grid.of, [{"a": [1, 2.5], "b": [True, False]}, {"c": ["x"]}, {"d": [3]}]))
    table = run_table(spark, grids)
    kinds = dict(table.dtypes)
    assert (kinds["param1_value"], kinds["param2_value"], kinds["param_value"]) == ("double", "boolean", "string")
    assert [tuple(r) for r in table.filter("grid_index = 2").select("param_value", "param1_value").collect()] == [("3", None)]


def test_wide_tables(spark):
    own = prices(3, 6)[["A2", "A0", "A1"]]
    wide = spark.createDataFrame(own.rename_axis("ts").reset_index())
    a, b = (sorted(map(str, market_panel(spark, w, lw.MarketData(x, x)).select("t_idx", "asset", "asset_idx", "close").collect())) for w, x in ((own, own), (wide, wide)))
    assert a == b
    with pytest.raises(ValueError, match="column ts"):
        market_panel(spark, wide.drop("ts"), lw.MarketData(wide, wide))

"""The golden cases of the replay, a scalar replay for whole panels, and slicing."""

import numpy as np
import pandas as pd
import pytest

from ledgerwake.config import SimConfig
from ledgerwake.operators import replay, slicing

N = float("nan")
# weights, close, exec, funding, settings, equity of each period
GOLDEN = {
    "fee": ((0, 1, 0), (100, 110, 120), None, None, {"fee_rate": 0.001}, (1000, 999, 1088.818181818182)),
    "carried series": ((1, 1, 1), (100, 110, 120), (100, 100, 110), None, {}, (1000, 1100, 1200)),
    "least order": ((1, 1.01, 1.01), (100,) * 3, None, None, {"fee_rate": 0.01, "order_notional_min": 1.0}, (990, 990, 990)),
    "closing ignores it": ((1, 0, 0), (100, 50, 50), None, None, {"fee_rate": 0.01, "order_notional_min": 750.0}, (990, 485, 485)),
    "funding long": ((1, 1, 1), (100,) * 3, None, (0.01,) * 3, {}, (990, 980.1, 970.299)),
    "funding short": ((-1, -1, -1), (100,) * 3, None, (0.01,) * 3, {}, (1010, 1020.1, 1030.301)),
    "no exec price": ((1, 1, 0), (100,) * 3, (100, N, N), None, {}, (1000, 1000, 1000)),
    "no close": ((1, 1, 1), (100, N, 100), (100,) * 3, (0, 0.01, 0), {}, (1000, 1000, 1000)),
    "never priced": ((1, 1, 0), (N, N, N), (N, N, N), None, {}, (1000, 1000, 1000)),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(name):
    weights, close, execution, funding, settings, expected = GOLDEN[name]
    book = replay.Book(1, SimConfig(**settings))
    rows = zip(weights, close, execution or close, funding or (0.0,) * 3)
    assert [book.step(*(np.array([float(v)]) for v in row))[0][1] for row in rows] == pytest.approx(expected, rel=1e-12)


def scalar(w, close, execution, funding, c):
    """The same portfolio with a loop over assets."""
    cash, n = c.init_cash, w.shape[1]
    units, last_e, last_c, out = [0.0] * n, [0.0] * n, [0.0] * n, []
    for t in range(len(w)):
        for a in range(n):
            last_e[a] = last_e[a] if np.isnan(execution[t, a]) else execution[t, a]
            last_c[a] = last_c[a] if np.isnan(close[t, a]) else close[t, a]
        equity = cash + sum(u * p for u, p in zip(units, last_e))
        for a in range(n):
            target = 0.0 if np.isnan(w[t, a]) else w[t, a]
            order = target * equity - units[a] * last_e[a]
            if target and (np.isnan(execution[t, a]) or abs(order) < c.order_notional_min):
                continue
            if order:
                cash -= order + abs(order) * c.fee_rate
                units[a] += order / (last_e[a] * (1 + (c.slippage_rate if order > 0 else -c.slippage_rate)))
        for a in range(n):
            if not np.isnan(close[t, a]) and not np.isnan(funding[t, a]):
                cash -= funding[t, a] * units[a] * last_c[a]
        out.append(cash + sum(u * p for u, p in zip(units, last_c)))
    return out


def frame(run_id, w, close, execution, funding):
    t, n = w.shape
    none = lambda x: [None if np.isnan(v) else float(v) for v in x.ravel()]
    return pd.DataFrame({"run_id": run_id, "t_idx": np.repeat(np.arange(t), n), "ts": np.repeat(pd.date_range("2024-01-01", periods=t), n), "asset": np.tile([f"a{k}" for k in range(n)], t), "asset_idx": np.tile(np.arange(n), t), "weight": none(w), "close": none(close), "exec": none(execution), "funding": none(funding)})


SCHEMA = "run_id string, t_idx int, ts timestamp_ntz, asset string, asset_idx int, weight double, close double, exec double, funding double"


@pytest.fixture(scope="module")
def panels():
    out = {}
    for run in range(3):
        draw = np.random.default_rng(run)
        close = 100 * np.cumprod(1 + draw.normal(0, 0.02, (40, 4)), axis=0)
        execution = np.vstack([close[:1], close[:-1]])
        w, funding = draw.normal(0, 0.3, close.shape), draw.normal(0, 1e-3, close.shape)
        for x in (w, close, execution, funding):
            x[draw.random(close.shape) < 0.1] = np.nan
        out[f"r{run}"] = (w, close, execution, funding)
    return out


def test_runs_equal_scalar_replay(spark, panels):
    config = SimConfig(fee_rate=0.001, slippage_rate=0.0005, order_notional_min=20.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # batches that end inside a period
    try:
        panel = spark.createDataFrame(pd.concat([frame(k, *v) for k, v in panels.items()]).sample(frac=1, random_state=1).replace({np.nan: None}), SCHEMA)
        rows = replay.periods(replay.replay(panel, config)).orderBy("run_id", "t_idx").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for run, values in panels.items():
        own = [r for r in rows if r.run_id == run]
        assert [r.equity for r in own] == pytest.approx(scalar(*values, config), rel=1e-9)
        assert own[0].ret == 0


def test_slices(spark):
    x = np.ones((6, 1))
    x[:2] = np.nan
    panel = spark.createDataFrame(frame("run", x, np.ones((6, 1)), np.ones((6, 1)), np.zeros((6, 1))).replace({np.nan: None}), SCHEMA)
    days = lambda **k: [(r.t_idx, r.ts.day) for r in slicing.sliced(panel, SimConfig(**k)).orderBy("t_idx").collect()]
    assert days(start_period="2024-01-02", end_period="2024-01-05") == [(0, 2), (1, 3), (2, 4), (3, 5)]
    assert days(start_period=1, end_period=4) == [(0, 2), (1, 3), (2, 4)]
    assert days(start_period=-2) == [(0, 5), (1, 6)]
    assert [d for _, d in days(trim_warmup=True)] == [3, 4, 5, 6]
    assert [d for _, d in days(trim_warmup=True, start_period="2024-01-04")] == [4, 5, 6]
    assert [d for _, d in days(trim_warmup=True, start_period="2024-01-02")] == [3, 4, 5, 6]
    with pytest.raises(ValueError):
        slicing.sliced(panel, SimConfig(start_period="2024-01-02", end_period=3))

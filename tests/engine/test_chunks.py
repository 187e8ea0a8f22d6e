"""Scans in chunks give what one scan over the whole history gives."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerwake.operators import curves


def runs():
    draw = random.Random(8)
    out = {"rises": [100.0 + k for k in range(40)], "falls": [100.0 - k for k in range(40)], "flat": [100.0] * 40, "short": [100.0, 90.0, 100.0]}
    for k in range(12):
        out[f"drawn{k}"] = [float(draw.choice((90, 95, 100, 105, 110)) if k % 2 else 100 + draw.gauss(0, 5)) for _ in range(draw.randrange(3, 60))]
    return out


def drawdowns(equity):
    peak, out = -1e300, []
    for x in equity:
        peak = max(peak, x)
        out.append((peak, x / peak - 1))
    return out


def islands(states):
    out = []
    for t, s in enumerate(states):
        if out and out[-1][0] == s:
            out[-1][2] += 1
        else:
            out.append([s, t, 1])
    return sorted(map(tuple, out), key=lambda x: x[1])


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_drawdowns_durations_and_recoveries(spark, chunk):
    own = runs()
    periods = spark.createDataFrame([(r, t, x) for r, e in own.items() for t, x in enumerate(e)], "run_id string, t_idx int, equity double")
    rows = {(r.run_id, r.t_idx): (r.peak, r.drawdown) for r in curves.with_drawdown(periods, chunk).collect()}
    assert rows == {(k, t): v for k, e in own.items() for t, v in enumerate(drawdowns(e))}
    longest = {r.run_id: r.drawdown_duration for r in curves.drawdown_durations(periods, chunk).collect()}
    assert longest == {k: max([n for s, _, n in islands([d < 0 for _, d in drawdowns(e)]) if s] or [0]) for k, e in own.items()}
    for r in curves.recoveries(periods, chunk).collect():
        e, d = own[r.run_id], drawdowns(own[r.run_id])
        trough = min(range(len(e)), key=lambda t: (d[t][1], t))
        peak_at = max(t for t in range(trough + 1) if e[t] == d[trough][0])
        back = next((t for t in range(trough, len(e)) if e[t] >= d[trough][0]), None)
        assert (r.trough, r.peak_at, r.time_to_recovery) == (trough, peak_at, 0 if d[trough][1] == 0 else None if back is None else back - peak_at)


@pytest.mark.parametrize("chunk", [1, 2, 7, 100_000])
def test_islands(spark, chunk):
    draw = random.Random(9)
    own = {k: [draw.choice((None, 0.0, 1.0, -1.0)[: 2 + k % 3]) for _ in range(1 + 5 * k)] for k in range(12)} | {99: [1.0] * 50}
    rows = spark.createDataFrame([(k, t, s) for k, states in own.items() for t, s in enumerate(states)], "k int, t_idx int, s double")
    got = {}
    for r in curves.island_lengths(rows, ["k"], "s", chunk).collect():
        got.setdefault(r.k, []).append((r.s, r.start, r.length))
    assert {k: sorted(v, key=lambda x: x[1]) for k, v in got.items()} == {k: islands(v) for k, v in own.items()}


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_compounded_returns(spark, chunk):
    """Total losses, and worse, among the returns."""
    own = {"plain": [0.0, 0.1, -0.2, None, 0.05] * 8, "lost": [0.1] * 9 + [-1.0] + [0.1] * 9, "worse": [0.1] * 9 + [-1.5] + [0.2] * 9 + [-2.0, 0.1]}
    periods = spark.createDataFrame([(k, t, x) for k, r in own.items() for t, x in enumerate(r)], "run_id string, t_idx int, ret double")
    got = {(r.run_id, r.t_idx): r.equity for r in curves.compounded(periods, 50.0, chunk).collect()}
    for k, returns in own.items():
        equity = 50.0
        for t, x in enumerate(returns):
            equity *= 1 + (x or 0.0)
            assert got[k, t] == pytest.approx(equity, rel=1e-12)


def test_positions_that_start_late(spark):
    """Chunks of an asset that is there in some periods only."""
    rows = spark.createDataFrame([("r", 5 + t, 0, 1.0) for t in range(20)] + [("r", t, 1, float(t // 4 % 2)) for t in range(30)], "run_id string, t_idx int, asset_idx int, units double")
    assert curves.holding_periods(rows, 7).first().holding_period == curves.holding_periods(rows).first().holding_period
    assert rows.agg(F.count(F.lit(1))).first()[0] == 50

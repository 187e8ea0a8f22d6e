"""The replay of a portfolio, period by period.

The order of a period depends on the equity that all earlier ones have left: this is the one step that windows can't express.
Runs are dealt over the tasks; in a task, rows come sorted by run and period, and the book of a run is carried from batch to
batch. So a task holds a batch and one book (some numbers for each asset), however many periods a run has. A lost task
is replayed from its rows.

Without costs, least order and missing prices the recursion has a closed form, and frictionless() is made of windows alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SimConfig
from ..functions.stats import by_asset, by_time, ratio
from ..functions.zones import with_zone, zone_of

SCHEMA = """
    run_id string, t_idx int, ts {ts}, equity_before double, equity double, cash double, fees double, funding double, slippage double, turnover double,
    weight_turnover double, gross_exposure double, net_exposure double, order_count long, order_notional double,
    asset_idx array<int>, units array<double>, order_value array<double>, close_value array<double>
"""
_FIELDS = [f.split()[0] for f in SCHEMA.split(",")]


class Book:
    """What a run carries from one period to the next."""

    def __init__(self, n: int, config: SimConfig):
        self.config, self.cash = config, float(config.init_cash)
        self.units, self.exec, self.close, self.weights = np.zeros(n), np.full(n, np.nan), np.full(n, np.nan), None

    def step(self, weight: np.ndarray, close: np.ndarray, execution: np.ndarray, funding: np.ndarray) -> tuple:
        """Trades one period; missing values are NaN. An execution price of 0 counts as missing."""
        c = self.config
        execution = np.where(execution == 0, np.nan, execution)
        self.exec, self.close = np.where(np.isnan(execution), self.exec, execution), np.where(np.isnan(close), self.close, close)
        price, mark, target = np.nan_to_num(self.exec), np.nan_to_num(self.close), np.nan_to_num(weight)
        before = self.cash + float(self.units @ price)
        order = target * before - self.units * price
        held_back = np.isnan(execution) | (np.abs(order) < c.order_notional_min)
        order[held_back & (target != 0)] = 0.0
        size, buys, sells = np.abs(order), order[order > 0].sum(), -order[order < 0].sum()
        paid = price * np.where(order > 0, 1 + c.slippage_rate, 1 - c.slippage_rate)
        traded = np.divide(order, paid, out=np.zeros_like(order), where=order != 0)
        slippage = buys * c.slippage_rate / (1 + c.slippage_rate) + sells * c.slippage_rate / (1 - c.slippage_rate)
        fees = size.sum() * c.fee_rate
        self.cash -= order.sum() + fees
        self.units = self.units + traded
        value = self.units * mark
        earned = -float((np.where(np.isnan(close), 0.0, np.nan_to_num(funding)) * value).sum())
        self.cash += earned
        gross, net = np.abs(value).sum(), value.sum()
        equity = self.cash + net
        share = value / equity if equity else np.zeros_like(value)
        moved = 0.0 if self.weights is None else 0.5 * np.abs(share - self.weights).sum()
        self.weights = share
        scale = abs(equity)
        return (
            before, equity, self.cash, fees, earned, slippage, min(buys, sells) / abs(before) if before else 0.0, moved,
            gross / scale if scale else 0.0, net / scale if scale else 0.0, int((order != 0).sum()), size.sum(),
        ), self.units, order, value


def replay(panel: DataFrame, config: SimConfig) -> DataFrame:
    """A row of SCHEMA for each run and period, with the positions of all its assets as arrays in the order of asset_idx."""
    kind = dict(panel.dtypes)["ts"]
    values = ["weight", "close", "exec", "funding"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, book, of = None, None, None
        for batch in chain(batches, [None]):
            frame = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
            if frame is None or not len(frame):
                continue
            run_id, t = frame["run_id"].to_numpy(), frame["t_idx"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (run_id[1:] != run_id[:-1]) | (t[1:] != t[:-1])])
            ends = np.r_[starts[1:], len(frame)]
            whole = len(starts) if batch is None else len(starts) - 1
            x, asset, ts, rows = frame[values].to_numpy(np.float64), frame["asset_idx"].to_numpy(), frame["ts"], []
            for a, b in zip(starts[:whole], ends[:whole]):
                if run_id[a] != of:
                    book, of = Book(b - a, config), run_id[a]
                numbers, *arrays = book.step(*x[a:b].T)
                rows.append((of, t[a], ts.iloc[a], *numbers, asset[a:b], *arrays))
            held = frame.iloc[starts[whole] :] if whole < len(starts) else None
            if rows:
                yield pd.DataFrame(rows, columns=_FIELDS)

    ordered = panel.select("run_id", "t_idx", "ts", "asset_idx", *values).repartition("run_id").sortWithinPartitions("run_id", "t_idx", "asset_idx")
    return with_zone(ordered.mapInPandas(run, SCHEMA.format(ts=kind)), zone_of(panel))


def periods(replayed: DataFrame) -> DataFrame:
    """One row for each run and period, with its return: 0 in the first, and where the equity before was 0."""
    change = ratio(F.col("equity"), F.lag("equity").over(by_time())) - 1
    return replayed.drop("asset_idx", "units", "order_value", "close_value").withColumn("ret", F.coalesce(change, F.lit(0.0)))


def positions(replayed: DataFrame) -> DataFrame:
    """One row for each run, period and asset: units, order_value, close_value."""
    each = F.explode(F.arrays_zip("asset_idx", "units", "order_value", "close_value")).alias("p")
    return replayed.select("run_id", "t_idx", "ts", "equity", each).select("run_id", "t_idx", "ts", "equity", "p.*")


def carried_prices(panel: DataFrame) -> DataFrame:
    """The panel with exec_carried and close_carried: the last known price so far in the run; null before the first."""
    w = by_asset().rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumns({f"{c}_carried": F.last(c, ignorenulls=True).over(w) for c in ("exec", "close")})


def frictionless(panel: DataFrame, init_cash: float = 1000.0) -> DataFrame:
    """(run_id, t_idx, ts, equity) where nothing costs and no price is missing: equity before a period grows by the weights on the change of the execution price, less funding; a running product."""
    w = F.coalesce("weight", F.lit(0.0))
    held = ratio(F.col("close"), F.col("exec"))
    paid = F.coalesce("funding", F.lit(0.0)) * w * held
    own = panel.withColumn("_next", F.lead("exec").over(by_asset()))
    sums = own.groupBy("run_id", "t_idx", "ts").agg(
        F.sum(w * (ratio(F.col("_next"), F.col("exec")) - 1)).alias("gain"), F.sum(w * (held - 1)).alias("inside"), F.sum(paid).alias("paid")
    )
    before = F.coalesce(F.product(1 + F.coalesce("gain", F.lit(0.0)) - F.col("paid")).over(by_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    return sums.select("run_id", "t_idx", "ts", (init_cash * before * (1 + F.col("inside") - F.col("paid"))).alias("equity"))

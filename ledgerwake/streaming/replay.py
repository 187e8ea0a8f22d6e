"""The replay over a stream of periods, with each run's book as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SimConfig
from ..operators.replay import Book

OUT = "run_id string, t_idx int, equity double, fees double, funding double, turnover double, gross_exposure double, net_exposure double, order_count long"


def _each(name: str):
    return F.transform("cells", lambda c: c.getField(name)).alias(name)


def whole_periods(panel: DataFrame) -> DataFrame:
    """One row for each run and period, its assets' values as arrays in the order of asset_idx: what a source of the stream has to hold."""
    cell = F.struct("asset_idx", "weight", "close", "exec", "funding")
    return panel.groupBy("run_id", "t_idx").agg(F.sort_array(F.collect_list(cell)).alias("cells")).select("run_id", "t_idx", *(_each(n) for n in ("weight", "close", "exec", "funding")))


def replay_stream(periods: DataFrame, config: SimConfig) -> DataFrame:
    """A row for each period as it arrives. A run's periods have to come in order, several to a batch or not: one that is older than the last is an error, so that nothing is passed over in silence."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, book = (state.get[0], pickle.loads(state.get[1])) if state.exists else (-1, None)
        rows = []
        for t, *values in sorted(pd.concat(list(frames))[["t_idx", "weight", "close", "exec", "funding"]].itertuples(index=False), key=lambda r: r[0]):
            if t <= last:
                raise ValueError(f"period {t} of run {key[0]!r} came after period {last}")
            arrays = [np.array(v, np.float64) for v in values]
            book = book or Book(len(arrays[0]), config)
            n, *_ = book.step(*arrays)
            rows.append((key[0], t, n[1], n[3], n[4], n[6], n[8], n[9], n[10]))
            last = t
        state.update((int(last), pickle.dumps(book)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return periods.groupBy("run_id").applyInPandasWithState(step, OUT, "last int, book binary", "append", "NoTimeout")

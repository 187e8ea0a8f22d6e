"""Exponentially weighted means over histories of any length.

A known value turns the mean before it into a * mean + b. Such maps compose to one of the same form, so a history is cut in
blocks of periods: each block's map is computed where its rows are, the few maps of an asset are composed in order, and each
block then starts from the mean that the blocks before it leave. Within a batch maps are composed by doubling, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.written import written

#: Periods of a block.
BLOCK = 1 << 16
_STATE = "run_id string, asset_idx int, block long, mean double, last long, known long"


def composed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the maps x -> a x + b up to each place make of the start; the first one has to be constant (a = 0)."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a) and a[step:].any():
        b[step:] = a[step:] * b[:-step] + b[step:]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return b


def _first(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return new


def _maps(gap: np.ndarray, value: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """The map of a value that is known so many periods after the last one: what came before has aged by the decay of each."""
    with np.errstate(under="ignore"):
        weight = decay ** gap.astype(np.float64)
    return weight / (weight + 1 - decay), (1 - decay) * value / (weight + 1 - decay)


def _columns(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, ...]:
    """Run, asset, period and value of a batch; missing and infinite values are NaN."""
    run = np.unique(np.array(batch["run_id"].to_pandas(), dtype=object).astype(str), return_inverse=True)[1] if len(batch) else np.zeros(0, int)
    value = batch[column].to_numpy(zero_copy_only=False).astype(np.float64)
    return run, batch["asset_idx"].to_numpy(zero_copy_only=False), batch["t_idx"].to_numpy(zero_copy_only=False).astype(np.int64), np.where(np.isinf(value), np.nan, value)


def _summaries(column: str, decay: float, block: int):
    """A row for each stretch of a block that a batch holds: its known values, where they begin and end, the first one, and the map of the others."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            run, asset, t, value = _columns(batch, column)
            known = np.flatnonzero(~np.isnan(value))
            if not len(known):
                continue
            own = _first(run[known], asset[known], t[known] // block)
            a, b = _maps(np.where(own, 0, np.diff(t[known], prepend=0)), value[known], decay)
            heads = np.flatnonzero(own)
            ends = np.append(heads[1:], len(known)) - 1
            factor = np.multiply.reduceat(np.where(own, 1.0, a), heads)
            rest = composed(np.where(own, 0.0, a), np.where(own, 0.0, b))[ends]
            at = known[heads]
            yield pa.RecordBatch.from_arrays([batch["run_id"].take(pa.array(at)), pa.array(asset[at], pa.int32()), pa.array(t[at] // block), pa.array(t[at]), pa.array(t[known[ends]]), pa.array(value[at]), pa.array(ends - heads + 1), pa.array(factor), pa.array(rest)], ["run_id", "asset_idx", "block", "first", "last", "value", "known", "factor", "rest"])

    return told


def _starts(decay: float):
    """For one asset: the mean, the last known period and the number of known values before each of its blocks that has any, and after the last one."""

    def told(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["block", "first"])
        first, last, factor, rest = (frame[c].to_numpy() for c in ("first", "last", "factor", "rest"))
        a, b = _maps(np.append(0, first[1:] - last[:-1]), frame["value"].to_numpy(), decay)
        a[0], b[0] = 0.0, frame["value"].iloc[0]
        mean = composed(factor * a, factor * b + rest)
        known, block = np.cumsum(frame["known"].to_numpy()), frame["block"].to_numpy()
        ends = np.append(np.flatnonzero(np.diff(block)), len(block) - 1)
        return pd.DataFrame({"run_id": frame["run_id"].iloc[0], "asset_idx": frame["asset_idx"].iloc[0], "block": block[ends], "mean": mean[ends], "last": last[ends], "known": known[ends]})

    return told


def _spans(state: DataFrame, last: int) -> DataFrame:
    """The state for each block that starts after one with known values: that of the nearest one before it."""
    following = F.lead("block").over(Window.partitionBy("run_id", "asset_idx").orderBy("block"))
    spread = state.withColumn("_to", F.coalesce(following, F.lit(last))).filter("_to > block")
    return spread.withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("_to")))).drop("_to")


def ewma(panel: DataFrame, column: str, into: str, decay: float, least_periods: int = 1, block: int = BLOCK) -> DataFrame:
    """The panel with the exponentially weighted mean of a column over each asset's whole history, as pandas' ewm(adjust=False, min_periods).

    Mean = decay * mean before + (1 - decay) * value, from the first known value on. A missing value leaves the mean as it is,
    while what it is made of ages. Null until least_periods values are known. A task gets one block of periods of an asset; what
    an asset brings together is a row for each of its blocks.
    """
    blocks = panel.withColumn("_block", F.floor(F.col("t_idx") / block).cast("long"))
    keys = ["run_id", "asset_idx", "_block"]
    longer = panel.agg(F.max("t_idx")).first()[0]
    state = panel.sparkSession.createDataFrame([], _STATE)
    if longer is not None and longer >= block:
        ordered = blocks.select(*keys, "t_idx", F.col(column).cast("double").alias("_x")).repartition(*keys).sortWithinPartitions(*keys, "t_idx")
        parts = ordered.mapInArrow(_summaries("_x", decay, block), "run_id string, asset_idx int, block long, first long, last long, value double, known long, factor double, rest double")
        state = written(parts.groupBy("run_id", "asset_idx").applyInPandas(_starts(decay), _STATE), "means")
        state = _spans(state, int(longer) // block)
    start = state.select("run_id", "asset_idx", F.col("block").alias("_block"), F.col("mean").alias("_mean"), F.col("last").alias("_last"), F.col("known").alias("_known"))
    joined = blocks.join(start, keys, "left").repartition(*keys).sortWithinPartitions(*keys, "t_idx")
    names = panel.columns

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, mean, last, count = None, np.nan, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            run, asset, t, value = _columns(batch, column)
            own = _first(run, asset, t // block)
            start = [batch[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("_mean", "_last", "_known")]
            key = batch["run_id"][0].as_py(), asset[0], t[0] // block
            if key == of:  # the batch goes on with the block of the one before
                start[0][0], start[1][0], start[2][0] = mean, last, count
            heads = np.flatnonzero(own)
            segment = np.cumsum(own) - 1
            known = ~np.isnan(value)
            at = np.flatnonzero(known)
            whose = segment[at]
            lead = _first(whose) if len(at) else np.zeros(0, bool)
            carried, since, before = (x[heads][whose] for x in start)
            has = ~np.isnan(carried)
            gap = np.where(lead, t[at] - np.where(has, since, 0), np.diff(t[at], prepend=0))
            a, b = _maps(gap, value[at], decay)
            b = np.where(lead, np.where(has, a * np.where(has, carried, 0) + b, value[at]), b)
            found = composed(np.where(lead, 0.0, a), b)
            # each row shows the mean at its last known value, or at the block's start
            upto = np.cumsum(known) - 1
            inside = upto >= np.searchsorted(at, heads)[segment]
            shown = np.where(inside, found[np.maximum(upto, 0)] if len(at) else np.nan, start[0][heads][segment])
            counts = np.nan_to_num(start[2][heads])[segment] + np.where(inside, upto - np.searchsorted(at, heads)[segment] + 1, 0)
            seen = np.where(inside, t[at][np.maximum(upto, 0)] if len(at) else 0, start[1][heads][segment])
            of, mean, last, count = (batch["run_id"][len(batch) - 1].as_py(), asset[-1], t[-1] // block), shown[-1], seen[-1], counts[-1]
            told = counts >= max(1, least_periods)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(shown, pa.float64(), mask=~told)], [*names, into])

    return joined.mapInArrow(smooth, StructType([*panel.schema.fields, StructField(into, DoubleType())]))

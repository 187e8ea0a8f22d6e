"""Cutting a panel in time, before anything is replayed: state and look-ahead live inside a run's own slice."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SimConfig
from ..functions import zones


def _padded(label: str) -> str:
    return {4: f"{label}-01-01", 7: f"{label}-01"}.get(len(label), label)


def _end_of(end: str) -> pd.Timestamp:
    """The first moment after a text bound: a bare date covers its whole day, a bare month or year likewise; other texts cover the second that they name."""
    unit = {4: "years", 7: "months", 10: "days", 16: "minutes"}.get(len(end), "seconds")
    return pd.Timestamp(_padded(end)) + pd.DateOffset(**{unit: 1})


def by_label(panel: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Periods from start to end, both included; the labels need not be there. Of instants, labels are wall times of the panel's zone, unless they name one of their own."""
    zone = zones.zone_of(panel)
    if start is not None:
        panel = panel.filter(F.col("ts") >= zones.at(_padded(start), zone))
    if end is not None:
        panel = panel.filter(F.col("ts") < zones.at(_end_of(end) if re.fullmatch(r"[\d-]+([ T][\d:]+)?", end) else end, zone))
    return panel


def by_position(panel: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Periods numbered from start up to end, which is excluded; negative ones count from the end."""
    last = F.max("t_idx").over(Window.partitionBy("run_id")) if (start or 0) < 0 or (end or 0) < 0 else None
    bound = lambda k: F.lit(k) if k >= 0 else F.col("_n") + k
    out = panel if last is None else panel.withColumn("_n", last + 1)
    if start is not None:
        out = out.filter(F.col("t_idx") >= bound(start))
    if end is not None:
        out = out.filter(F.col("t_idx") < bound(end))
    return out if last is None else out.drop("_n")


def renumbered(panel: DataFrame) -> DataFrame:
    """t_idx from 0 in each run."""
    return panel.withColumn("t_idx", (F.col("t_idx") - F.min("t_idx").over(Window.partitionBy("run_id"))).cast("int"))


def without_warmup(panel: DataFrame) -> DataFrame:
    """Each run from its first period with a weight on; a run without any keeps nothing."""
    first = panel.filter("weight is not null").groupBy("run_id").agg(F.min("t_idx").alias("_first"))
    return panel.join(first, "run_id").filter("t_idx >= _first").drop("_first")


def sliced(panel: DataFrame, config: SimConfig) -> DataFrame:
    """The config's periods. The warm-up is looked for in the whole panel, so that the later of both starts holds."""
    start, end = config.start_period, config.end_period
    kinds = {type(x) for x in (start, end) if x is not None}
    if len(kinds) > 1:
        raise ValueError("start_period and end_period must both be text or both be positions")
    if config.trim_warmup:
        panel = without_warmup(panel)
    if not kinds:
        return renumbered(panel) if config.trim_warmup else panel
    return renumbered(by_label(panel, start, end) if str in kinds else by_position(panel, start, end))

"""walk_forward(): calendar folds are runs of one panel, and so one job."""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import FoldConfig, MarketData, SimConfig
from ..functions import zones
from ..operators import metrics, slicing
from ..sources.frames import market_panel
from ..sources.written import written
from .results import Delegates, MetricKey, SimulationResult
from .simulate import Runs, checked

# Metrics that are aggregated over folds where none are named.
DEFAULT_AGGREGATE_METRICS = [
    "Annualized return %", "Annualized volatility", "Annualized Sharpe", "Max drawdown (equity) %", "Total return %",
    "Annualized Sortino", "Downside deviation", "VaR 95%", "CVaR 95%", "Calmar ratio", "Omega Ratio", "Ulcer Index",
    "Skewness", "Kurtosis", "Hit rate", "Profit factor", "Annual Turnover (1-way)", "Fees",
    "Gross exposure mean %", "Net exposure mean %", "Weight IC mean (next)",
]
# Months of the calendar units.
_MONTHS = {"ME": 1, "M": 1, "MS": 1, "QE": 3, "Q": 3, "QS": 3, "YE": 12, "Y": 12, "A": 12, "YS": 12}
#: Rows of three numbers up to which the folds' bounds are broadcast.
MOST_BROADCAST = 500_000
_FIXED = {"D": timedelta(days=1), "h": timedelta(hours=1), "H": timedelta(hours=1), "min": timedelta(minutes=1), "T": timedelta(minutes=1)}


def boundaries(start: datetime, end: datetime, fold_period: str, align_start: bool = True) -> Iterator[datetime]:
    """The instants at which folds begin, up to a day after end. Month, quarter and year units are stamped at their ends ("3ME" from January: 31 January, 30 April, ...) unless they end in S; weeks begin on Sundays. What lies before the first one is in no fold."""
    m = re.fullmatch(r"(\d*)([A-Za-z]+)", fold_period)
    if not m or m[2] not in _MONTHS and m[2] not in _FIXED and m[2] != "W":
        raise ValueError(f"fold_period {fold_period!r} is not known")
    step, unit, last = int(m[1] or 1), m[2], end + timedelta(days=1)
    day = start.replace(hour=0, minute=0, second=0, microsecond=0)
    time_of_day = timedelta() if align_start else start - day
    if unit in _MONTHS:
        months, at_end = _MONTHS[unit], not unit.endswith("S")
        k = start.year * 12 + start.month - 1
        k += -(k + at_end) % months  # the unit's last month, or its first
        stamp = lambda k: datetime(k // 12, k % 12 + 1, monthrange(k // 12, k % 12 + 1)[1] if at_end else 1) + time_of_day
        if stamp(k) < (day if align_start else start) and not at_end and not (align_start and months == 1):
            k += months
        while (at := stamp(k)) <= last:
            yield at
            k += step * months
        return
    if unit == "W":
        at, by = day + timedelta(days=(6 - day.weekday()) % 7) + time_of_day, timedelta(weeks=step)
    else:
        by = step * _FIXED[unit]
        at = start if not align_start else day if unit == "D" else start.replace(second=0, microsecond=0, **({"minute": 0} if unit in "hH" else {}))
    while at <= last:
        yield at
        at += by


def zoned_boundaries(start: pd.Timestamp, end: pd.Timestamp, fold_period: str, align_start: bool = True) -> list[pd.Timestamp]:
    """boundaries() in the zone of start and end: calendar units follow its clocks, hours and minutes its instants."""
    zone = start.tz
    if zone is None:
        return [pd.Timestamp(t) for t in boundaries(start.to_pydatetime(), end.to_pydatetime(), fold_period, align_start)]
    local = [zones.localized(pd.Timestamp(t), zone) for t in boundaries(*(t.tz_localize(None).to_pydatetime() for t in (start, end)), fold_period, align_start)]
    m = re.fullmatch(r"(\d*)([A-Za-z]+)", fold_period)
    if not local or m[2] not in ("h", "H", "min", "T"):
        return local
    by = int(m[1] or 1) * _FIXED[m[2]]
    return list(pd.date_range(local[0], end + timedelta(days=1), freq=pd.Timedelta(by)))


def span_of(panel: DataFrame) -> tuple[pd.Timestamp, pd.Timestamp]:
    """First and last period, in the panel's zone."""
    span, zone = panel.agg(F.min(_micros(panel)).alias("a"), F.max(_micros(panel)).alias("b")).first(), zones.zone_of(panel)
    moment = lambda us: pd.Timestamp(us, unit="us") if zone is None else pd.Timestamp(us, unit="us", tz="UTC").tz_convert(zone)
    return moment(span["a"]), moment(span["b"])


def _micros(panel: DataFrame) -> Column:
    """Microseconds from 1970 on to ts: of wall times by their own clock."""
    if zones.zone_of(panel) is None:
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return F.unix_micros("ts")


def with_folds(panel: DataFrame, stamps: list[pd.Timestamp], min_periods: int) -> DataFrame:
    """The panel with each fold as a run of its own; fold_index counts those of at least min_periods. A fold reaches from one of the rising stamps to the next, the last one to the end.

    Time is cut in buckets as long as the shortest fold, so that a fold lies in a few of them: periods find their fold by their
    bucket, and only periods, not the panel, are joined with the folds that a list of the driver names.
    """
    spark = panel.sparkSession
    edges = [t.value // 1000 for t in stamps]
    last = panel.agg(F.max(_micros(panel))).first()[0]
    spans = [(a, b) for a, b in zip(edges, [*edges[1:], max(edges[-1:] + [last or 0]) + 1])] if edges else []
    width = max(1, min((b - a for a, b in spans), default=1), (spans[-1][1] - spans[0][0]) // (4 * len(spans) + 1) if spans else 1)
    rows = [(k, a, b) for a, b in spans for k in range(a // width, (b - 1) // width + 1)]
    bounds = spark.createDataFrame(rows, "_bucket long, lo long, hi long")
    periods = panel.select("ts", _micros(panel).alias("_at")).distinct().withColumn("_bucket", F.floor(F.col("_at") / width))
    dated = periods.join(F.broadcast(bounds) if len(rows) <= MOST_BROADCAST else bounds, "_bucket").filter("_at >= lo and _at < hi").select("ts", "lo")
    sizes = dated.groupBy("lo").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_periods)
    starts = sizes.withColumn("fold_index", (F.row_number().over(Window.orderBy("lo")) - 1).cast("int"))
    cut = panel.drop("run_id").join(dated.join(starts, "lo").select("ts", "fold_index"), "ts")
    return slicing.renumbered(cut.withColumn("run_id", F.concat(F.lit("fold-"), F.col("fold_index")))).select("fold_index", *panel.columns)


@dataclass(frozen=True)
class FoldResult:
    fold_index: int
    start_period: datetime
    end_period: datetime
    n_periods: int
    result: SimulationResult


@dataclass(frozen=True)
class FoldAggregation:
    """values: the metric of every fold, null where it has none."""

    metric_key: str
    values: list[float | None]
    median: float
    mean: float
    std: float
    min: float
    max: float
    count: int


def aggregated(tall: DataFrame, names: list[str]) -> DataFrame:
    """(metric, median, mean, std, min, max, count) over the runs that have a value; std is 0 for one value."""
    v = F.col("value_double")
    own = tall.filter(F.col("metric").isin(names) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return own.groupBy("metric").agg(F.median(v).alias("median"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"))


def fold_rows(panel: DataFrame) -> DataFrame:
    """(fold_index, run_id, start_period, end_period, n_periods) of a panel that has folds; the periods as clocks in its zone show them."""
    zone = zones.zone_of(panel)
    return panel.groupBy("fold_index", "run_id").agg(zones.wall_time(F.min("ts"), zone).alias("start_period"), zones.wall_time(F.max("ts"), zone).alias("end_period"), (F.max("t_idx") + 1).cast("long").alias("n_periods"))


@dataclass(frozen=True)
class WalkForwardResult(Delegates):
    """Metrics are those of full_result, the run over all periods. summary: a row for each fold with the aggregated metrics."""

    folds: tuple[FoldResult, ...]
    aggregations: dict[str, FoldAggregation]
    fold_config: FoldConfig
    sim_config: SimConfig
    summary: DataFrame = field(repr=False)
    full_result: SimulationResult | None = None

    def _target(self):
        return self.full_result

    def _missing(self):
        return "Cannot access metrics: full_result is None (include_full_result=False)"

    def metric_aggregation(self, metric_key: str) -> FoldAggregation | None:
        return self.aggregations.get(metric_key)

    def fold_metric_values(self, metric_key: str) -> pd.Series:
        own = self.aggregations.get(metric_key)
        return pd.Series(dtype=float) if own is None else pd.Series(own.values, name=metric_key, dtype=float)

    def summary_stats(self, metric_keys: list[str] | None = None) -> pd.DataFrame:
        own = [self.aggregations[k] for k in metric_keys or self.aggregations if k in self.aggregations]
        return pd.DataFrame([{"Metric": a.metric_key, "Median": a.median, "Mean": a.mean, "Std": a.std, "Min": a.min, "Max": a.max, "Count": a.count} for a in own])


def walk_forward(*, weights: Any, market: MarketData, config: SimConfig | None = None, fold_config: FoldConfig | None = None, metrics_to_aggregate: list[str] | None = None, include_full_result: bool = True, spark: SparkSession | None = None) -> WalkForwardResult:
    """Simulates every fold from the initial cash anew, and the whole if asked. In folds, the settings of the signal's diagnostics are the default ones. A ValueError if no fold has enough periods."""
    spark, config, fold_config = spark or SparkSession.active(), config or SimConfig(), fold_config or FoldConfig()
    panel = checked(written(slicing.sliced(market_panel(spark, weights, market), config), "panel"), config)
    stamps = zoned_boundaries(*span_of(panel), fold_config.fold_period, fold_config.align_start)
    none = ValueError(f"no fold of {fold_config.fold_period} has {fold_config.min_periods} periods")
    if not stamps:
        raise none
    cut = with_folds(panel, stamps, max(3, fold_config.min_periods))
    cut = written(cut, "folds")
    rows = fold_rows(cut).orderBy("fold_index").collect()
    if not rows:
        raise none
    plain = SimConfig()
    own = replace(config, start_period=None, end_period=None, trim_warmup=False, **{k: getattr(plain, k) for k in ("compute_signal_diagnostics", "signal_decay_horizons", "signal_cost_per_turnover")})
    runs = Runs(cut.drop("fold_index"), own)
    wide = written(runs.facts(), "fold-facts")
    names = metrics_to_aggregate or DEFAULT_AGGREGATE_METRICS
    tall = metrics.tall(wide).filter(F.col("metric").isin(names))
    stats = {r["metric"]: r for r in aggregated(tall, names).collect()}
    values = {(r["run_id"], r["metric"]): r["value_double"] for r in tall.collect()}
    found = {k: FoldAggregation(k, [values.get((r["run_id"], k)) for r in rows], *(stats[k][c] for c in ("median", "mean", "std", "min", "max", "count"))) for k in names if k in stats}
    summary = fold_rows(cut).join(wide.select("run_id", *(F.col(metrics.COLUMN_OF[k]).alias(k) for k in found)), "run_id").drop("run_id").orderBy("fold_index")
    folds = tuple(FoldResult(r["fold_index"], r["start_period"], r["end_period"], r["n_periods"], runs.result(r["run_id"], wide)) for r in rows)
    full = Runs(panel, config).result("run") if include_full_result else None
    return WalkForwardResult(folds, found, fold_config, config, summary, full)


__all__ = ["DEFAULT_AGGREGATE_METRICS", "FoldAggregation", "FoldResult", "MetricKey", "WalkForwardResult", "walk_forward"]

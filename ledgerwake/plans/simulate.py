"""simulate(): weights and market to a result."""

from __future__ import annotations

from collections.abc import Collection
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MarketData, SimConfig
from ..operators import metrics, replay, slicing
from ..sources.frames import market_panel
from ..sources.written import written
from .results import SimulationResult


class Runs:
    """Any number of runs of one panel, replayed in one job and written; what else each column needs is computed when it is asked for."""

    def __init__(self, panel: DataFrame, config: SimConfig):
        self.config = config
        self.panel = panel
        self.replayed = written(replay.replay(panel, config), "replayed")
        self.periods, self.positions = replay.periods(self.replayed), replay.positions(self.replayed)

    def facts(self, categories: Collection[str] = metrics.CATEGORIES) -> DataFrame:
        return metrics.facts(self.panel, self.periods, self.positions, self.config, categories)

    def result(self, run_id: str, wide: DataFrame | None = None) -> SimulationResult:
        own = lambda df: df.filter(F.col("run_id") == run_id)
        panel, periods, positions = map(own, (self.panel, self.periods, self.positions))
        measure = lambda: metrics.tall(metrics.facts(panel, periods, positions, self.config) if wide is None else own(wide))
        return SimulationResult(run_id, self.config, panel, periods, positions, measure)


def checked(panel: DataFrame, config: SimConfig) -> DataFrame:
    """Raises a ValueError for a run of fewer than 3 periods, or where the benchmark asset isn't there."""
    state = panel.groupBy("run_id").agg(F.max("t_idx").alias("last"), F.max((F.col("asset") == F.lit(config.benchmark_asset)).cast("int")).alias("has"))
    worst = state.agg(F.count(F.lit(1)).alias("n"), F.min("last").alias("last"), F.min(F.coalesce("has", F.lit(0))).alias("has")).first()
    if not worst["n"] or worst["last"] < 2:
        raise ValueError("at least 3 periods are needed")
    if config.benchmark_asset is not None and not worst["has"]:
        raise ValueError(f"benchmark asset {config.benchmark_asset!r} is not in the market")
    return panel


def simulate(*, weights: Any, market: MarketData, config: SimConfig | None = None, spark: SparkSession | None = None) -> SimulationResult:
    """Replays target weights against the market. See sources.frames for what the tables may be."""
    config = config or SimConfig()
    spark = spark or SparkSession.active()
    panel = checked(written(slicing.sliced(market_panel(spark, weights, market), config), "panel"), config)
    return Runs(panel, config).result("run")

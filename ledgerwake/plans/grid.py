"""grid_search(): all combinations of the parameter grids are runs of one panel, and so one job."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from enum import Enum
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MarketData, SimConfig
from ..operators import slicing
from ..operators.metrics import COLUMN_OF, METRICS, NAMES
from ..sources.frames import PANEL, long_frame, market_panel
from ..sources.written import written
from .results import Delegates, SimulationResult
from .simulate import Runs, checked
from .weights import ByAsset


class Metrics(str, Enum):
    """Objectives by a short name. Three of them name no metric, and are answered by a KeyError."""

    # Fixed values.
    SHARPE = "Annualized Sharpe"
    RETURN = "Annualized return %"
    SORTINO = "Annualized Sortino"
    CALMAR = "Calmar ratio"
    INFO_RATIO = "Information ratio"
    MAX_DRAWDOWN = "Max drawdown (equity) %"
    VOLATILITY = "Annualized volatility %"
    ALPHA = "Annualized alpha %"
    BETA = "Beta"
    WEIGHT_IC_MEAN = "Weight IC mean (next)"
    WEIGHT_IC_SHARPE = "Weight IC Sharpe (next)"


@dataclass(frozen=True)
class Grid:
    """One or two parameters and the values to try."""

    params: tuple[tuple[str, tuple], ...]

    @classmethod
    def of(cls, spec: Any) -> Grid:
        if not isinstance(spec, Mapping):
            raise TypeError("a parameter grid is a mapping from names to values")
        if len(spec) not in (1, 2):
            raise ValueError("a parameter grid has one or two parameters")
        for name, values in spec.items():
            if not isinstance(name, str) or not name:
                raise ValueError("parameters are named by text")
            if not len(list(values)):
                raise ValueError(f"{name} has no values")
            if len(set(values)) < len(list(values)):
                raise ValueError(f"{name} has a value twice")
        return cls(tuple((k, tuple(v)) for k, v in spec.items()))

    @property
    def name(self) -> str:
        return " x ".join(k for k, _ in self.params)

    def is_1d(self) -> bool:
        return len(self.params) == 1

    def is_2d(self) -> bool:
        return len(self.params) == 2


@dataclass(frozen=True)
class GridSearchBest:
    grid_index: int
    grid_name: str
    params: dict[str, Any]
    objective_metric: str
    objective_value: float
    result: SimulationResult


@dataclass(frozen=True)
class GridSearchResults(Delegates):
    """table: a row for each combination, in order. Metrics are those of the best result."""

    table: DataFrame = field(repr=False)
    param_grids: tuple[Grid, ...]
    objective_metric: str
    best: GridSearchBest | None

    def _target(self):
        return self.best.result if self.best else None

    def _missing(self):
        return "Cannot access metrics: no valid results exist (best is None)"

    def for_grid(self, index: int = 0) -> DataFrame:
        return self.table.filter(F.col("grid_index") == index)

    def pivot(self, *, grid_index: int = 0) -> DataFrame:
        """The first parameter's values down, the second's across, both in the order of the grid."""
        grid = self.param_grids[grid_index]
        if grid.is_1d():
            raise ValueError(f"pivot() is for grids of two parameters; grid {grid_index} has one")
        (down, _), (_, across) = grid.params
        own = self.for_grid(grid_index)
        kind = dict(own.dtypes)["param2_value"]
        of = lambda v: F.first(F.when(F.col("param2_value") == F.lit(_as(kind, v)), F.col("objective_value")), ignorenulls=True).alias(str(v))
        return own.groupBy("param1_value").agg(F.min("position").alias("_first"), *map(of, across)).orderBy("_first").drop("_first").withColumnRenamed("param1_value", down)

    def top(self, n: int = 10) -> DataFrame:
        """The n highest objectives, whatever the direction of the search."""
        return self.table.orderBy(F.desc_nulls_last("objective_value"), "grid_index", "position").limit(n)

    def summary(self) -> DataFrame:
        v = F.col("objective_value")
        return self.table.groupBy("grid_index", "grid_name").agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))

    def plot(self, *, grid_index: int = 0, title: str | None = None) -> str:
        """SVG: a line for one parameter, a heat map for two."""
        from .report import grid_chart

        return grid_chart(self, grid_index, title)

    def heatmaps(self) -> list[str]:
        return [self.plot(grid_index=k) for k, g in enumerate(self.param_grids) if g.is_2d()]


def first_best(table: DataFrame, maximize: bool = True) -> DataFrame:
    """The row of the best objective; of several, the first by grid and position."""
    order = F.desc("objective_value") if maximize else F.asc("objective_value")
    return table.filter(F.col("objective_value").isNotNull() & ~F.isnan("objective_value")).orderBy(order, "grid_index", "position").limit(1)


def _kind(values: list) -> str:
    """The type of a column of parameter values: that of numbers where all are, else text."""
    if all(isinstance(v, bool) for v in values):
        return "boolean"
    if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in values):
        return "string"
    return "bigint" if all(isinstance(v, int) for v in values) else "double"


def _as(kind: str, value: Any) -> Any:
    return str(value) if kind == "string" else float(value) if kind == "double" else value


def run_table(spark: SparkSession, grids: tuple[Grid, ...]) -> DataFrame:
    """(run_id, grid_index, grid_name, position, parameters and their values); grids of one and of two parameters have columns of their own, null in the others. A column's values are numbers if they are in all grids, else text."""
    parts, tried = [], {n: [v for g in grids if len(g.params) == size for v in g.params[k][1]] for n, size, k in (("param", 1, 0), ("param1", 2, 0), ("param2", 2, 1))}
    kinds = {n: _kind(v) for n, v in tried.items()}
    for g, grid in enumerate(grids):
        names = ("param",) if grid.is_1d() else ("param1", "param2")
        rows = [(f"{g}-{k}", g, grid.name, k, *(x for n, (name, _), v in zip(names, grid.params, values) for x in (name, _as(kinds[n], v)))) for k, values in enumerate(product(*(v for _, v in grid.params)))]
        parts.append(spark.createDataFrame(rows, "run_id string, grid_index int, grid_name string, position int, " + ", ".join(f"{n}_name string, {n}_value {kinds[n]}" for n in names)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def together(frames: list[DataFrame]) -> DataFrame:
    """The union of the frames, in halves: a plan as deep as their number would be analysed anew at each step."""
    if len(frames) == 1:
        return frames[0]
    middle = len(frames) // 2
    return together(frames[:middle]).unionByName(together(frames[middle:]))


def grid_search(*, generate_weights: Callable[[Mapping], Any], objective_metric: str | Metrics = Metrics.SHARPE, maximize: bool = True, base_params: Mapping | None = None, param_grids: list, market: MarketData, config: SimConfig | None = None, spark: SparkSession | None = None, progress: bool = False, max_workers: int | None = None, use_multiprocessing: bool = False, executor: Any = None) -> GridSearchResults:
    """Simulates every combination. generate_weights gives the weights for a mapping of parameters, as a long DataFrame (ts, asset, value) or a wide frame, and is called on the driver for each; or it is weights.ByAsset, whose callable runs on the executors. The last four arguments have no effect: Spark spreads the runs.

    Diagnostics are off during the search, so that an objective of the signal is null for all; the best run has them again.
    """
    spark, config = spark or SparkSession.active(), config or SimConfig()
    objective = objective_metric.value if isinstance(objective_metric, Metrics) else objective_metric
    if objective not in COLUMN_OF:
        raise KeyError(f"no metric {objective!r}; there are {NAMES[:25]} ...")
    grids = tuple(map(Grid.of, param_grids))
    if not grids:
        raise ValueError("param_grids is empty")
    base = dict(base_params or {})
    if overridden := sorted({name for g in grids for name, _ in g.params} & set(base)):
        warnings.warn(f"grids override base_params: {overridden}", stacklevel=2)
    combos = {f"{g}-{k}": base | dict(zip([n for n, _ in grid.params], values)) for g, grid in enumerate(grids) for k, values in enumerate(product(*(v for _, v in grid.params)))}
    cells = market_panel(spark, market.close_prices, market).drop("run_id", "weight")
    if isinstance(generate_weights, ByAsset):
        weights, at = generate_weights.weights(cells, combos), ["t_idx", "asset_idx"]
    else:
        weights, at = together([long_frame(spark, generate_weights(params), "weight").select(F.lit(run_id).alias("run_id"), "ts", "asset", "weight") for run_id, params in combos.items()]), ["ts", "asset"]
    panel = written(cells.join(weights, at).select(*PANEL), "panel")
    counts = panel.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.agg(F.count(F.lit(1)).alias("runs"), F.min("n").alias("low"), F.max("n").alias("high")).first()
    if (seen["runs"], seen["low"], seen["high"]) != (len(combos), cells.count(), seen["low"]):
        raise ValueError("each combination's weights must have the market's periods and assets")
    panel = checked(slicing.sliced(panel, config), config)
    runs = Runs(panel, replace(config, compute_signal_diagnostics=False))
    value = F.col(COLUMN_OF[objective]).cast("double")
    found = runs.facts([next(m[0] for m in METRICS if m[1] == objective)]).select("run_id", value.alias("objective_value"))
    table = run_table(spark, grids).withColumn("objective_metric", F.lit(objective)).join(found, "run_id", "left")
    table = written(table, "grid").orderBy("grid_index", "position")
    best = None
    if row := first_best(table, maximize).first():
        result = Runs(panel.filter(F.col("run_id") == row["run_id"]), config).result(row["run_id"])
        best = GridSearchBest(row["grid_index"], row["grid_name"], combos[row["run_id"]], objective, row["objective_value"], result)
    return GridSearchResults(table, grids, objective, best)


"""Portfolio backtest analytics on Spark."""

from .config import FoldConfig, MarketData, SimConfig
from .operators.metrics import TEARSHEET_NOTES
from .plans.folds import DEFAULT_AGGREGATE_METRICS, FoldAggregation, FoldResult, WalkForwardResult, walk_forward
from .plans.grid import GridSearchBest, GridSearchResults, Metrics, grid_search
from .plans.report import tearsheet
from .plans.results import MetricKey, MetricsAccessor, MetricsArtifacts, SimulationResult, metrics_artifacts
from .plans.simulate import simulate
from .plans.weights import ByAsset, gross_scaled

__version__ = "0.1.0"
__all__ = [
    "ByAsset", "DEFAULT_AGGREGATE_METRICS", "FoldAggregation", "FoldConfig", "FoldResult", "GridSearchBest", "GridSearchResults", "MarketData", "MetricKey",
    "Metrics", "MetricsAccessor", "MetricsArtifacts", "SimConfig", "SimulationResult", "TEARSHEET_NOTES", "WalkForwardResult", "grid_search", "gross_scaled",
    "metrics_artifacts", "simulate", "tearsheet", "walk_forward",
]

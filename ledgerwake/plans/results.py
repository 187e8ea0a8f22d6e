"""What the entry points return: handles on lazy DataFrames. Only the metrics of a run, some 71 rows, are ever collected, once."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SimConfig
from ..operators import curves, signal
from ..operators.metrics import METRICS, NAMES


class MetricKey:
    """A constant for each metric's name, such as MetricKey.ANNUALIZED_SHARPE: the name in capitals, with PCT for the per cent sign."""

    @classmethod
    def all_keys(cls) -> list[str]:
        return list(NAMES)

    @classmethod
    def keys_by_category(cls) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for category, name, *_ in METRICS:
            found.setdefault(category, []).append(name)
        return found


for _name in NAMES:
    _plain = _name.replace("t-stat", "tstat").replace("1-way", "1way").replace("Weight-based", "Weight").replace("%", " pct")
    setattr(MetricKey, "_".join(re.findall(r"[A-Za-z0-9]+", _plain)).upper(), _name)


@runtime_checkable
class MetricsAccessor(Protocol):
    def metric_value(self, metric: str, *, default: object = None) -> object: ...

    def available_metrics(self, category: str | None = None) -> list[str]: ...

    def metrics_dict(self, category: str | None = None) -> dict[str, object]: ...


class SignalArtifacts:
    """Tables on the signal; each is None where diagnostics are off. Series have their own name as their column: ic_series is (run_id, t_idx, ts, ic)."""

    #: Series by accessor: the column of weight_forward, where it isn't that of the accessor.
    SERIES = {
        "ic_series": "ic", "rank_ic_series": "rank_ic", "decile_spread_series": "top_bottom_spread", "directionality_series": "directionality",
        "forward_return_per_gross_series": "forward_return_per_gross", "long_hit_rate_series": "long_hit_weighted", "short_hit_rate_series": "short_hit_weighted",
        "gross_weight_series": "gross_weight",
    }

    def __init__(self, result: SimulationResult):
        self._result = result

    def _table(self, make):
        return make() if self._result.config.compute_signal_diagnostics else None

    @property
    def weight_forward(self) -> DataFrame | None:
        return self._table(lambda: signal.cross_sections(self._result.panel))

    def _series(self, column: str) -> DataFrame | None:
        return self._table(lambda: self.weight_forward.select("run_id", "t_idx", "ts", column))

    def __getattr__(self, name: str):
        if name in self.SERIES:
            column = self.SERIES[name]
            return self._table(lambda: self._series(column).withColumnRenamed(column, name.removesuffix("_series")))
        if name in ("ic", "rank_ic", "top_bottom_spread", "gross_weight", "net_weight", "directionality", "forward_return", "forward_return_per_gross", "forward_return_selection", "forward_return_selection_per_gross", "forward_return_directional", "forward_return_directional_per_gross", "long_gross_weight", "short_gross_weight", "long_hit_weighted", "short_hit_weighted", "long_forward_return_per_gross", "short_forward_return_per_gross"):
            return self._series(name)
        if name.startswith("weight_forward_deciles"):
            column = name.removeprefix("weight_forward_deciles").lstrip("_") or "mean"
            return self._table(lambda: signal.decile_curves(self._result.panel).select("run_id", "decile", column))
        raise AttributeError(name)

    @property
    def alpha_decay_next_return_by_type(self) -> DataFrame | None:
        return self._table(lambda: signal.alpha_decay(self._result.panel))

    @property
    def decay_horizons(self) -> DataFrame | None:
        return self._table(lambda: signal.horizon_decay(self._result.panel, self._result.config.horizons))

    @property
    def by_asset(self) -> DataFrame | None:
        return self._table(lambda: signal.by_assets(self._result.panel))

    def rolling(self, window: int = 90, min_periods: int | None = None) -> DataFrame | None:
        """None where the run is shorter than the window."""
        if not self._result.config.compute_signal_diagnostics or self._result.n_periods < window:
            return None
        return signal.rolling(self.weight_forward, window, min_periods)

    def get(self, key: str, default: object = None) -> object:
        try:
            found = getattr(self, key)
        except AttributeError:
            return default
        return default if found is None else found


class MetricsArtifacts:
    """The series of a run, each a DataFrame (run_id, t_idx, ts, and the series by its own name)."""

    SERIES = ("equity", "turnover", "weight_turnover", "transaction_costs", "n_positions", "net_exposure", "gross_exposure", "long_exposure", "short_exposure", "concentration", "long_exposure_notional", "short_exposure_notional", "concentration_notional")

    def __init__(self, result: SimulationResult):
        self._result, self.signal = result, SignalArtifacts(result)

    @property
    def init_cash(self) -> float:
        return self._result.config.init_cash

    @cached_property
    def table(self) -> DataFrame:
        r = self._result
        cash = float(r.config.init_cash)
        out = curves.artifacts(r.periods, r.positions, r.panel).withColumnRenamed("ret", "returns")
        return out.withColumns({"returns_pct": F.col("returns") * 100, "equity_pct": (F.col("equity") / cash - 1) * 100, "drawdown_pct": F.col("drawdown") * 100})

    def __getattr__(self, name: str):
        if name in (*self.SERIES, "returns", "returns_pct", "equity_pct", "drawdown_pct"):
            return self.table.select("run_id", "t_idx", "ts", name)
        raise AttributeError(name)

    @property
    def benchmark_equity(self) -> DataFrame | None:
        return self._result.benchmark_equity

    @property
    def benchmark_equity_pct(self) -> DataFrame | None:
        found, cash = self.benchmark_equity, float(self.init_cash)
        return None if found is None else found.select("run_id", "t_idx", "ts", ((F.col("benchmark_equity") / cash - 1) * 100).alias("benchmark_equity_pct"))

    def rolling_sharpe(self, window: int = 30, min_periods: int = 6) -> DataFrame:
        return curves.rolling_sharpe(self._result.periods, self._result.config, window, min_periods)

    def get(self, key: str, default: object = None) -> object:
        try:
            found = getattr(self, key)
        except AttributeError:
            return default
        return default if found is None else found


@dataclass(frozen=True)
class SimulationResult:
    """One run. panel, periods and positions are its rows alone; metrics is the tall table of its metrics, made when it is first asked for."""

    run_id: str
    config: SimConfig
    panel: DataFrame = field(repr=False)
    periods: DataFrame = field(repr=False)
    positions: DataFrame = field(repr=False)
    measure: Callable[[], DataFrame] = field(repr=False)

    @cached_property
    def metrics(self) -> DataFrame:
        return self.measure()

    @property
    def returns(self) -> DataFrame:
        return self.periods.select("t_idx", "ts", "ret")

    @property
    def equity(self) -> DataFrame:
        return self.periods.select("t_idx", "ts", "equity")

    @property
    def benchmark_equity(self) -> DataFrame | None:
        if self.config.benchmark_asset is None:
            return None
        return curves.benchmark(self.panel, self.config).select("run_id", "t_idx", "ts", "benchmark_equity")

    @property
    def artifacts(self) -> MetricsArtifacts:
        return MetricsArtifacts(self)

    @cached_property
    def n_periods(self) -> int:
        return self.periods.count()

    @cached_property
    def _values(self) -> dict[str, tuple[str, Any]]:
        first = lambda r: next((x for x in (r["value_double"], r["value_string"], r["value_ts"]) if x is not None), None)
        rows = self.metrics.orderBy("ordinal").collect()
        return {r["metric"]: (r["category"], int(v) if r["metric"] == "Total order count" and v is not None else v) for r in rows for v in [first(r)]}

    def metric_value(self, metric: str, *, default: object = None) -> object:
        """The value; the default where it is missing or null."""
        value = self._values.get(metric, (None, None))[1]
        return default if value is None or value != value else value

    def available_metrics(self, category: str | None = None) -> list[str]:
        return [k for k, (c, _) in self._values.items() if category in (None, c)]

    def metrics_dict(self, category: str | None = None) -> dict[str, object]:
        return {k: self.metric_value(k) for k in self.available_metrics(category)}


def metrics_artifacts(result: SimulationResult) -> MetricsArtifacts:
    return result.artifacts


class Delegates:
    """Metrics by way of another result, which may be missing."""

    def _target(self) -> SimulationResult | None:
        raise NotImplementedError

    def _missing(self) -> str:
        raise NotImplementedError

    def _present(self) -> SimulationResult:
        found = self._target()
        if found is None:
            raise ValueError(self._missing())
        return found

    def metric_value(self, metric: str, *, default: object = None) -> object:
        """Without a result: the default if there is one, else a ValueError."""
        if self._target() is None and default is not None:
            return default
        return self._present().metric_value(metric, default=default)

    def available_metrics(self, category: str | None = None) -> list[str]:
        return self._present().available_metrics(category)

    def metrics_dict(self, category: str | None = None) -> dict[str, object]:
        return self._present().metrics_dict(category)

"""Inputs and settings of a backtest."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

# Seconds of the frequency units that have a fixed length.
_SECONDS = {
    "D": 86400, "h": 3600, "H": 3600, "min": 60, "T": 60, "s": 1, "S": 1, "ms": 1e-3, "us": 1e-6, "ns": 1e-9,
}

#: Horizons of the signal decay where none are given.
DECAY_HORIZONS = (1, 3, 5, 10, 21)


@dataclass(frozen=True)
class MarketData:
    """Prices and funding rates, each as a long DataFrame (ts, asset, value) or as a wide pandas frame or series. funding_rates None means no funding. time_zone: where the calendar of instants is read; None for that of a pandas index, or else the session's."""

    close_prices: Any
    exec_prices: Any
    funding_rates: Any = None
    time_zone: str | None = None


@dataclass(frozen=True)
class SimConfig:
    """Settings of a simulation. Rates are decimals; start_period and end_period are both text (both ends included, a bare date as end meaning that whole day) or both positions (end excluded)."""

    init_cash: float = 1000.0
    benchmark_asset: str | None = None
    order_notional_min: float = 0.0
    fee_rate: float = 0.0
    slippage_rate: float = 0.0
    start_period: str | int | None = None
    end_period: str | int | None = None
    trim_warmup: bool = False
    freq_rule: str = "1D"
    trading_days_year: int = 365
    risk_free_rate: float = 0.0
    compute_signal_diagnostics: bool = True
    signal_decay_horizons: tuple[int, ...] | None = None
    signal_cost_per_turnover: float = 0.001

    @property
    def annual_factor(self) -> float:
        """Periods a year. Frequencies without a fixed length count as days."""
        m = re.fullmatch(r"(\d*)([A-Za-z]+)", self.freq_rule.strip())
        seconds = int(m[1] or 1) * _SECONDS.get(m[2], 0) if m else 0
        return self.trading_days_year * 86400 / seconds if seconds else float(self.trading_days_year)

    @property
    def period_risk_free(self) -> float:
        return (1 + self.risk_free_rate) ** (1 / self.annual_factor) - 1

    @property
    def horizons(self) -> list[int]:
        return sorted({int(h) for h in self.signal_decay_horizons or DECAY_HORIZONS if h >= 1})


@dataclass(frozen=True)
class FoldConfig:
    """How walk_forward cuts time: a frequency such as "3ME", "1YE", "30D" or "1W", the periods that a fold needs, and whether the first boundary is aligned with the calendar."""

    fold_period: str = "3ME"
    min_periods: int = 3
    align_start: bool = True

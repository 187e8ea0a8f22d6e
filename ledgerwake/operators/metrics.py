"""The metrics of a run: one wide row of facts for each run, and the tall table made of it."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SimConfig
from ..functions.stats import compound, kurtosis, power, ratio, skewness
from ..functions.zones import wall_time, zone_of
from ..sources.written import written
from . import curves, signal
from .selection import quantile

# Category, name, column of the facts, and what it is, in the order of the table.
METRICS = [
    ("Meta", "Period frequency", "period_frequency", "Length of a period, from which the annual factor follows."),
    ("Meta", "Benchmark Asset", "benchmark_asset", "Asset that the benchmark block compares with."),
    ("Meta", "Fee %", "fee", "Fee on traded notional, as a decimal."),
    ("Meta", "Slippage %", "slippage_rate", "Slippage against the trader, as a decimal."),
    ("Meta", "Init Cash", "init_cash", "Cash before the first period."),
    ("Meta", "Trading Days Year", "trading_days_year", "Days that count as a year."),
    ("Meta", "Risk Free Rate", "risk_free_rate", "Annual, as a decimal."),
    ("Meta", "Simulation start date", "start_date", "First period."),
    ("Meta", "Simulation end date", "end_date", "Last period."),
    ("Meta", "First transaction date", "first_transaction", "First period with an order."),
    ("Performance", "Annualized return %", "annual_return", "Compound return a year, as a decimal. More is better."),
    ("Performance", "Annualized volatility", "volatility", "Sample deviation of returns, annualised. Less is calmer."),
    ("Performance", "Annualized Sharpe", "sharpe", "Excess return over volatility. More is better."),
    ("Performance", "Max drawdown (equity) %", "max_drawdown_pct", "Deepest fall from a peak. Nearer to 0 is better."),
    ("Performance", "Total return %", "total_return_pct", "Last equity over the initial cash. More is better."),
    ("Performance", "Total return", "total_return", "Last equity less the initial cash. More is better."),
    ("Costs", "Funding earnings", "funding_earned", "Sum of funding; negative if paid."),
    ("Costs", "Funding % total return", "funding_pct_return", "Funding as a part of the total return."),
    ("Costs", "Fees", "fees_paid", "Sum of fees. Less is better."),
    ("Costs", "Daily Turnover (1-way)", "turnover_mean", "The smaller of buys and sells over equity, by period."),
    ("Costs", "Annual Turnover (1-way)", "turnover_annual", "The same for a year."),
    ("Costs", "Daily Weight-based Turnover", "weight_turnover_mean", "Half of the change of held weights, by period."),
    ("Costs", "Annual Weight-based Turnover", "weight_turnover_annual", "The same for a year."),
    ("Costs", "Total order count", "order_total", "Orders of any size."),
    ("Costs", "Average order notional", "order_mean", "Mean size of an order."),
    ("Exposure", "Gross exposure mean %", "gross_mean_pct", "Sizes of all positions over equity, on average."),
    ("Exposure", "Gross exposure max %", "gross_max_pct", "The same at its highest."),
    ("Exposure", "Net exposure mean %", "net_mean_pct", "Signed positions over equity, on average."),
    ("Exposure", "Net exposure max %", "net_max_pct", "The same at its largest size."),
    ("Benchmark", "Alpha", "alpha", "Annual excess return that the benchmark doesn't explain. More is better."),
    ("Benchmark", "Beta", "beta", "Slope of excess returns on those of the benchmark."),
    ("Benchmark", "Benchmark annualized return %", "benchmark_return_pct", "Compound return of the benchmark a year."),
    ("Benchmark", "Active annual return %", "active_return_pct", "Mean return over the benchmark, for a year."),
    ("Benchmark", "Tracking error", "tracking_error", "Deviation of the returns over the benchmark, annualised."),
    ("Benchmark", "Information ratio", "information_ratio", "Active return over tracking error. More is better."),
    ("Benchmark", "R2 vs benchmark", "r2", "Part of the variance that the benchmark explains."),
    ("Distribution", "Calmar ratio", "calmar", "Annual return over the deepest drawdown. More is better."),
    ("Distribution", "Skewness", "skewness", "Of returns, without bias."),
    ("Distribution", "Kurtosis", "kurtosis", "Excess kurtosis of returns, without bias."),
    ("Distribution", "Best period return", "best_return", "Highest return of a period."),
    ("Distribution", "Worst period return", "worst_return", "Lowest return of a period."),
    ("Distribution", "Hit rate", "hit_rate", "Part of the periods with a change that gain."),
    ("Distribution", "Profit factor", "profit_factor", "Sum of gains over sum of losses. More is better."),
    ("Distribution", "Max drawdown duration (periods)", "drawdown_duration", "Longest time under water."),
    ("Distribution", "Time to recovery (periods)", "time_to_recovery", "From the peak before the deepest drawdown until it is reached again."),
    ("Portfolio", "Average holding period", "holding_period", "Mean time that a position keeps its side."),
    ("Portfolio", "Costs % gross pnl", "costs_pct_gross", "Fees and slippage as a part of the result before them."),
    ("Portfolio", "Funding % total pnl", "funding_pct_pnl", "Funding as a part of the total return."),
    ("Portfolio", "Average funding settled", "funding_mean", "Mean funding of a period."),
    ("Portfolio", "Max abs weight", "max_abs_weight", "Largest target weight of either sign."),
    ("Risk", "Annualized Sortino", "sortino", "Excess return over downside deviation. More is better."),
    ("Risk", "Downside deviation", "downside_deviation", "Deviation of the losing periods' returns, annualised."),
    ("Risk", "VaR 95%", "var_95", "Return that a twentieth of the periods don't reach."),
    ("Risk", "CVaR 95%", "cvar_95", "Mean return of those periods."),
    ("Risk", "Omega Ratio", "omega", "Sum of gains over sum of losses."),
    ("Risk", "Ulcer Index", "ulcer", "Root mean square of drawdowns, scaled to a year."),
    ("Signal", "Weight IC mean (next)", "ic_mean", "Correlation of weights with next returns, on average."),
    ("Signal", "Weight IC t-stat (next)", "ic_tstat", "Its mean over the standard error."),
    ("Signal", "Weight Rank IC mean (next)", "rank_ic_mean", "The same for ranks."),
    ("Signal", "Weight Rank IC t-stat (next)", "rank_ic_tstat", "Its mean over the standard error."),
    ("Signal", "Top-bottom decile spread mean (next)", "spread_mean", "Return of the highest weights less that of the lowest."),
    ("Signal", "Top-bottom decile spread t-stat (next)", "spread_tstat", "Its mean over the standard error."),
    ("Signal", "Weighted long hit rate mean (next)", "long_hit_mean", "Part of the long weight that gains."),
    ("Signal", "Weighted short hit rate mean (next)", "short_hit_mean", "Part of the short weight that gains."),
    ("Signal", "Forward return per gross mean (next)", "per_gross_mean", "Return of the weights over their gross."),
    ("Signal", "Forward return selection per gross mean (next)", "selection_mean", "The part of it that comes from choosing assets."),
    ("Signal", "Forward return selection per gross t-stat (next)", "selection_tstat", "Its mean over the standard error."),
    ("Signal", "Gross weight mean", "gross_weight_mean", "Mean sum of the weights' sizes."),
    ("Signal", "Directionality mean", "directionality_mean", "Mean of net over gross weight."),
    ("Signal", "Turnover-adjusted IC mean (next)", "adjusted_ic_mean", "Correlation, less for turnover."),
    ("Signal", "Net forward return per gross mean (next)", "net_per_gross_mean", "Return over gross, less the cost of turnover."),
]
CATEGORIES = list(dict.fromkeys(m[0] for m in METRICS))
NAMES = [m[1] for m in METRICS]
COLUMN_OF = {m[1]: m[2] for m in METRICS}
TEARSHEET_NOTES = {m[1]: m[3] for m in METRICS}
_TEXT, _TIMES = {"period_frequency", "benchmark_asset"}, {"start_date", "end_date", "first_transaction"}


def columns_of(category: str) -> list[str]:
    return [m[2] for m in METRICS if m[0] == category]


def period_facts(periods: DataFrame, config: SimConfig, tail: bool = True) -> DataFrame:
    """What one pass over the periods gives, and what follows from it; with tail, the returns' 5 % quantile and the mean up to it too."""
    af, ret = config.annual_factor, F.col("ret")
    year, init = F.lit(float(af)), F.lit(float(config.init_cash))
    marked = curves.with_drawdown(periods)
    shown = lambda ts: wall_time(ts, zone_of(periods))
    sums = marked.groupBy("run_id").agg(
        shown(F.min("ts")).alias("start_date"), shown(F.max("ts")).alias("end_date"), shown(F.min(F.when(F.col("order_count") > 0, F.col("ts")))).alias("first_transaction"),
        F.count(F.lit(1)).cast("double").alias("n"), compound(1 + ret).alias("growth"), (F.stddev_samp(ret) * F.sqrt(year)).alias("volatility"),
        (F.min("drawdown") * 100).alias("max_drawdown_pct"), F.max_by("equity", "t_idx").alias("last"),
        F.sum("funding").alias("funding_earned"), F.sum("fees").alias("fees_paid"), F.sum("slippage").alias("slipped"), F.avg("funding").alias("funding_mean"),
        F.avg("turnover").alias("turnover_mean"), F.avg("weight_turnover").alias("weight_turnover_mean"),
        F.sum("order_count").alias("order_total"), F.sum("order_notional").alias("ordered"),
        (F.avg("gross_exposure") * 100).alias("gross_mean_pct"), (F.max("gross_exposure") * 100).alias("gross_max_pct"),
        (F.avg("net_exposure") * 100).alias("net_mean_pct"), (F.max(F.abs("net_exposure")) * 100).alias("net_max_pct"),
        skewness(ret).alias("skewness"), kurtosis(ret).alias("kurtosis"), F.max(ret).alias("best_return"), F.min(ret).alias("worst_return"),
        F.count_if(ret > 0).alias("wins"), F.count_if(ret < 0).alias("losses"),
        F.sum(F.greatest(ret, F.lit(0.0))).alias("gained"), F.sum(F.least(ret, F.lit(0.0))).alias("lost"),
        (F.stddev_samp(F.when(ret < 0, ret)) * F.sqrt(year)).alias("_downside"),
        F.sqrt(F.avg(F.pow(100 * F.col("drawdown"), F.lit(2.0)))).alias("_ulcer"),
    )
    c, rf = F.col, config.risk_free_rate
    positive = lambda x, d: F.when(d > 0, ratio(x, d))
    out = sums.withColumn("annual_return", power(c("growth"), year / c("n")) - 1).withColumn("total_return", c("last") - init)
    net, costs = c("total_return"), c("fees_paid") + c("slipped")
    out = out.withColumns({
        "sharpe": positive(c("annual_return") - rf, c("volatility")), "total_return_pct": (c("last") / init - 1) * 100,
        "funding_pct_return": ratio(c("funding_earned"), net) * 100, "funding_pct_pnl": ratio(c("funding_earned"), net) * 100,
        "turnover_annual": c("turnover_mean") * af, "weight_turnover_annual": c("weight_turnover_mean") * af,
        "order_mean": F.coalesce(ratio(c("ordered"), c("order_total").cast("double")), F.lit(0.0)),
        "calmar": ratio(c("annual_return"), F.abs(c("max_drawdown_pct") / 100)),
        "hit_rate": ratio(c("wins").cast("double"), (c("wins") + c("losses")).cast("double")), "profit_factor": ratio(c("gained"), F.abs("lost")), "omega": ratio(c("gained"), F.abs("lost")),
        "costs_pct_gross": ratio(costs, F.abs(net + costs)) * 100,
        "downside_deviation": F.when(c("losses") > 1, c("_downside")).otherwise(0.0), "sortino": F.when(c("losses") > 1, positive(c("annual_return") - rf, c("_downside"))),
        "ulcer": c("_ulcer") * F.sqrt(year / c("n")),
    })
    if not tail:
        return out
    worst = quantile(written(periods.select("run_id", "ret"), "returns"), ["run_id"], "ret", 0.05)
    return out.join(worst.select("run_id", F.col("quantile").alias("var_95"), (F.col("tail_sum") / F.col("tail_count")).alias("cvar_95")), "run_id", "left")


def benchmark_facts(periods: DataFrame, panel: DataFrame, config: SimConfig) -> DataFrame:
    af, rf = config.annual_factor, config.period_risk_free
    both = periods.select("run_id", "t_idx", "ret").join(curves.benchmark(panel, config).select("run_id", "t_idx", "benchmark_ret"), ["run_id", "t_idx"])
    y, x, active = F.col("ret") - rf, F.col("benchmark_ret") - rf, F.col("ret") - F.col("benchmark_ret")
    sums = both.groupBy("run_id").agg(
        ratio(F.covar_samp(y, x), F.var_samp(x)).alias("beta"), F.avg(y).alias("_y"), F.avg(x).alias("_x"),
        ((power(compound(1 + F.col("benchmark_ret")), F.lit(af) / F.count(F.lit(1))) - 1) * 100).alias("benchmark_return_pct"), (F.avg(active) * af * 100).alias("active_return_pct"),
        (F.stddev_samp(active) * af**0.5).alias("tracking_error"), F.regr_r2(F.col("ret"), F.col("benchmark_ret")).alias("r2"),
    )
    informed = F.when(F.col("tracking_error") > 0, ratio(F.col("active_return_pct") / 100, F.col("tracking_error")))
    return sums.withColumn("alpha", (F.col("_y") - F.col("beta") * F.col("_x")) * af).withColumn("information_ratio", informed).drop("_y", "_x")


def facts(panel: DataFrame, periods: DataFrame, positions: DataFrame, config: SimConfig, categories: Collection[str] = CATEGORIES) -> DataFrame:
    """One row for each run with a column for each metric. Those of other categories than are asked for are null; so are the benchmark's without a benchmark asset, and the signal's without diagnostics. None of these costs anything."""
    parts = [panel.select("run_id").distinct()] if set(categories) <= {"Benchmark", "Signal"} else [period_facts(periods, config, "Risk" in categories)]
    if "Distribution" in categories:
        parts += [curves.drawdown_durations(periods), curves.recoveries(periods).select("run_id", "time_to_recovery")]
    if "Portfolio" in categories:
        parts += [curves.holding_periods(positions), panel.groupBy("run_id").agg(F.max(F.abs("weight")).alias("max_abs_weight"))]
    if "Benchmark" in categories and config.benchmark_asset is not None:
        parts.append(benchmark_facts(periods, panel, config))
    if "Signal" in categories and config.compute_signal_diagnostics:
        parts.append(signal.summary(signal.cross_sections(panel), periods, config.signal_cost_per_turnover))
    wide = reduce(lambda a, b: a.join(b, "run_id", "left"), parts)
    meta = {"period_frequency": config.freq_rule, "benchmark_asset": config.benchmark_asset, "fee": float(config.fee_rate), "slippage_rate": float(config.slippage_rate), "init_cash": float(config.init_cash), "trading_days_year": float(config.trading_days_year), "risk_free_rate": float(config.risk_free_rate)}
    wide = wide.withColumns({k: F.lit(v).cast("string" if k in _TEXT else "double") for k, v in meta.items()})
    kind = lambda c: "string" if c in _TEXT else "timestamp_ntz" if c in _TIMES else "double"
    missing = {m[2]: F.lit(None).cast(kind(m[2])) for m in METRICS if m[2] not in wide.columns}
    return wide.withColumns(missing).select("run_id", *(m[2] for m in METRICS))


def tall(wide: DataFrame) -> DataFrame:
    """(run_id, ordinal, category, metric, value_double, value_string, value_ts, note)."""
    def cell(k: int, category: str, name: str, column: str, note: str):
        time = F.col(column).cast("timestamp_ntz") if column in _TIMES else F.lit(None).cast("timestamp_ntz")
        number = F.lit(None).cast("double") if column in _TEXT | _TIMES else F.col(column).cast("double")
        text = F.col(column) if column in _TEXT else F.lit(None).cast("string")
        return F.struct(F.lit(k).alias("ordinal"), F.lit(category).alias("category"), F.lit(name).alias("metric"), number.alias("value_double"), text.alias("value_string"), time.alias("value_ts"), F.lit(note).alias("note"))

    return wide.select("run_id", F.explode(F.array(*(cell(k, *m) for k, m in enumerate(METRICS)))).alias("m")).select("run_id", "m.*")

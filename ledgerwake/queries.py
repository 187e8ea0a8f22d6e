"""The engine's queries by name: each operator over the whole monthly market of brands, with its SQL.

A query is a table of keys and of numbers, which both sides round to six places; prices are often exact ties there, and are
moved off them first, since the two engines round those differently.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle
from .config import FoldConfig, MarketData, SimConfig
from .functions import zones
from .functions.stats import by_asset, ratio
from .operators import curves, metrics, ranking, replay, signal, slicing, smoothing
from .plans import folds, grid, results
from .plans.simulate import simulate
from .plans.weights import ByAsset
from .sources import feather, frames, market, synthetic
from .sources.written import written

CONFIG = SimConfig(
    init_cash=oracle.INIT, benchmark_asset=oracle.BENCHMARK, order_notional_min=oracle.LEAST, fee_rate=oracle.FEE, slippage_rate=oracle.SLIP,
    freq_rule="30D", risk_free_rate=oracle.RISK_FREE, signal_decay_horizons=tuple(oracle.HORIZONS), signal_cost_per_turnover=oracle.COST,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(columns: str, sql: str | None = None):
    """Registers a query. columns: keys with their types, a bar, and numbers."""
    keys, _, numbers = columns.partition("|")
    keys = [k.partition(":")[::2] for k in keys.split()]

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = lambda k, t: F.col(k).cast(t).alias(k) if t else F.col(k)
            return f(spark, sf_dir).select(*(key(k, t) for k, t in keys), *((F.round(F.col(n).cast("double") + oracle.OFF_TIES, 6) + 0.0).alias(n) for n in numbers.split()))

        QUERIES[f.__name__] = shown
        if sql is not None:
            ORACLE_SQL[f.__name__] = oracle.whole(keys, numbers.split(), sql)
        return f

    return register


def panel_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market of months and brands, written once for all that a query makes of it."""
    return written(market.market(spark, sf_dir), "panel")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(panel_of(spark, sf_dir), CONFIG)


def periods_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.periods(replayed(spark, sf_dir))


def periods_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periods for what reads them more than once: the replay is written."""
    return replay.periods(written(replayed(spark, sf_dir), "replayed"))


def positions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.positions(replayed(spark, sf_dir))


AT = "t_idx:int ts"
CELL = "t_idx:int ts asset asset_idx:int"


@query(f"{CELL} | close exec funding", "SELECT * FROM panel")
def panel_dense(spark, sf_dir):
    return market.market(spark, sf_dir)


@query(f"{CELL} | weight", "SELECT * FROM panel")
def momentum_weights(spark, sf_dir):
    return panel_of(spark, sf_dir)


@query(f"{CELL} | forward", f"SELECT * FROM ({oracle.FORWARD})")
def forward_returns(spark, sf_dir):
    return signal.forward_returns(panel_of(spark, sf_dir))


@query(f"{CELL} | exec_carried close_carried", oracle.CARRIED)
def carry_forward_prices(spark, sf_dir):
    return replay.carried_prices(panel_of(spark, sf_dir))


@query(f"{CELL} | weight", "SELECT * REPLACE (t_idx - (SELECT min(t_idx) FROM panel WHERE weight IS NOT NULL) AS t_idx) FROM panel WHERE t_idx >= (SELECT min(t_idx) FROM panel WHERE weight IS NOT NULL)")
def warmup_trim(spark, sf_dir):
    return slicing.sliced(panel_of(spark, sf_dir), SimConfig(trim_warmup=True))


@query(f"{CELL} | close", "SELECT * REPLACE (t_idx - min(t_idx) OVER () AS t_idx) FROM panel WHERE ts >= '1996-03-15' AND ts < '1997-03-02'")
def slice_label(spark, sf_dir):
    return slicing.sliced(panel_of(spark, sf_dir), SimConfig(start_period="1996-03-15", end_period="1997-03-01"))


@query(f"{CELL} | close", "SELECT * REPLACE (t_idx - min(t_idx) OVER () AS t_idx, ts + INTERVAL 9 HOUR AS ts) FROM panel WHERE ts + INTERVAL 9 HOUR >= '1996-04-01 10:00' AND ts + INTERVAL 9 HOUR < '1997-03-02'")
def slice_zoned(spark, sf_dir):
    """Months that begin in London, cut by labels of Tokyo, nine hours ahead, and shown by its clocks."""
    panel = panel_of(spark, sf_dir)
    instants = zones.with_zone(panel.withColumn("ts", F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")))), "Asia/Tokyo")
    cut = slicing.sliced(instants, SimConfig(start_period="1996-04-01 10:00", end_period="1997-03-01"))
    return cut.withColumn("ts", zones.wall_time(F.col("ts"), zones.zone_of(cut)))


@query(f"{CELL} | close", "SELECT * REPLACE (t_idx - 3 AS t_idx) FROM panel WHERE t_idx >= 3 AND t_idx < (SELECT max(t_idx) FROM panel) - 4")
def slice_positional(spark, sf_dir):
    return slicing.sliced(panel_of(spark, sf_dir), SimConfig(start_period=3, end_period=-5))


@query(f"{AT} | equity ret cash", "SELECT * FROM periods")
def simulate_equity(spark, sf_dir):
    return periods_of(spark, sf_dir)


@query(f"{AT} order_count:bigint | fees slippage funding turnover weight_turnover order_notional", "SELECT * FROM periods")
def simulate_costs(spark, sf_dir):
    return periods_of(spark, sf_dir)


@query(f"{AT} | gross_exposure net_exposure long_exposure short_exposure long_exposure_notional short_exposure_notional", "SELECT * FROM periods JOIN exposures USING (run_id, t_idx)")
def simulate_exposures(spark, sf_dir):
    own = replayed(spark, sf_dir)
    return replay.periods(own).join(curves.exposures(replay.positions(own)).drop("ts"), ["run_id", "t_idx"])


@query(f"{AT} asset_idx:int | units order_value close_value", "SELECT * FROM positions")
def simulate_positions(spark, sf_dir):
    return positions_of(spark, sf_dir)


@query(f"{AT} | concentration concentration_notional", "SELECT * FROM periods JOIN exposures USING (run_id, t_idx)")
def concentration(spark, sf_dir):
    return curves.exposures(positions_of(spark, sf_dir))


@query("t_idx:int n_positions:bigint", "SELECT t_idx, count(*) FILTER (abs(weight) > 1e-8) AS n_positions FROM panel GROUP BY t_idx")
def n_positions(spark, sf_dir):
    return curves.weight_counts(panel_of(spark, sf_dir))


@query(f"{AT} | transaction_costs", "SELECT *, coalesce((fees + slippage) / nullif(equity, 0), 0) AS transaction_costs FROM periods")
def transaction_costs(spark, sf_dir):
    panel = panel_of(spark, sf_dir)
    own = written(replay.replay(panel, CONFIG), "replayed")
    return curves.artifacts(replay.periods(own), replay.positions(own), panel)


def _gap_free(spark, sf_dir):
    """Both prices carried, and 1 before any is known: a market without gaps."""
    filled = replay.carried_prices(panel_of(spark, sf_dir))
    return filled.withColumns({"exec": F.coalesce("exec_carried", F.lit(1.0)), "close": F.coalesce("close_carried", F.lit(1.0))})


@query(f"{AT} | equity", oracle.FRICTIONLESS)
def simulate_frictionless(spark, sf_dir):
    return replay.frictionless(_gap_free(spark, sf_dir), oracle.INIT)


@query(f"{AT} | equity", oracle.FRICTIONLESS)
def simulate_frictionless_replayed(spark, sf_dir):
    return replay.periods(replay.replay(_gap_free(spark, sf_dir), SimConfig(init_cash=oracle.INIT)))


@query(f"{AT} | equity peak drawdown", "SELECT * FROM drawdowns")
def drawdown_curve(spark, sf_dir):
    return curves.with_drawdown(periods_kept(spark, sf_dir))


@query(f"{AT} | rolling_sharpe", oracle.ROLLING_SHARPE)
def rolling_sharpe(spark, sf_dir):
    return curves.rolling_sharpe(periods_of(spark, sf_dir), CONFIG)


@query(f"{AT} | smoothed", "SELECT *, CASE WHEN count(turnover) OVER w >= 3 THEN avg(turnover) OVER w END AS smoothed FROM periods WINDOW w AS (ORDER BY t_idx ROWS 11 PRECEDING)")
def smoothed_turnover(spark, sf_dir):
    return curves.smoothed(periods_of(spark, sf_dir).withColumn("smoothed", F.col("turnover")), "smoothed", 12)


@query(f"{AT} | price benchmark_ret benchmark_equity", "SELECT * FROM bench")
def benchmark_curve(spark, sf_dir):
    return curves.benchmark(panel_of(spark, sf_dir), CONFIG)


@query("drawdown_duration:bigint", "SELECT drawdown_duration FROM duration")
def drawdown_duration(spark, sf_dir):
    return curves.drawdown_durations(periods_kept(spark, sf_dir))


@query("trough:int peak_at:int | time_to_recovery", "SELECT * FROM recovery")
def time_to_recovery(spark, sf_dir):
    return curves.recoveries(periods_kept(spark, sf_dir))


@query("| holding_period", "SELECT * FROM holding")
def holding_periods(spark, sf_dir):
    return curves.holding_periods(positions_of(spark, sf_dir))


@query("bin:int count:bigint | low high", oracle.HISTOGRAM)
def return_histogram(spark, sf_dir):
    from .plans.report import histogram

    return histogram(periods_of(spark, sf_dir), "ret", 20)


def _facts(spark, sf_dir, *categories: str):
    """Metrics of these categories, or of all; the panel is replayed once."""
    panel = panel_of(spark, sf_dir)
    own = written(replay.replay(panel, CONFIG), "replayed")
    return metrics.facts(panel, replay.periods(own), replay.positions(own), CONFIG, categories or metrics.CATEGORIES)


def _category(name: str, category: str) -> None:
    columns = [c for c in metrics.columns_of(category) if c != "order_total"]

    def facts(spark, sf_dir):
        return _facts(spark, sf_dir, category)

    facts.__name__ = name
    query(("order_total:bigint " if category == "Costs" else "") + "| " + " ".join(columns), "SELECT * FROM facts")(facts)


for _c in ("Performance", "Costs", "Exposure", "Benchmark", "Distribution", "Portfolio", "Risk", "Signal"):
    _category(f"metrics_{_c.lower()}", _c)


@query("period_frequency benchmark_asset start_date end_date first_transaction | fee slippage_rate init_cash trading_days_year risk_free_rate", oracle.META)
def metrics_meta(spark, sf_dir):
    return _facts(spark, sf_dir, "Meta")


@query("ordinal:int category metric | value_double", oracle.tall([(k, m[0], m[1], m[2]) for k, m in enumerate(metrics.METRICS) if m[0] not in ("Meta",)]))
def metrics_table(spark, sf_dir):
    return metrics.tall(_facts(spark, sf_dir)).filter(F.col("category") != "Meta")


@query(f"{AT} | ic", "SELECT * FROM sections")
def ic_series(spark, sf_dir):
    return signal.cross_sections(panel_of(spark, sf_dir))


@query(f"{AT} | rank_ic", "SELECT * FROM sections")
def rank_ic_series(spark, sf_dir):
    return signal.cross_sections(panel_of(spark, sf_dir))


@query(f"{AT} | ic rank_ic top_bottom_spread", "SELECT * FROM sections")
def rank_ic_wide(spark, sf_dir):
    """Cross-sections as a market of many assets has them: each period's assets ranked by ranges."""
    return signal.cross_sections(panel_of(spark, sf_dir), wide=True)


@query(f"{AT} | gross_weight net_weight directionality", "SELECT * FROM sections")
def gross_net_directionality(spark, sf_dir):
    return signal.cross_sections(panel_of(spark, sf_dir))


@query(f"{AT} | forward_return forward_return_per_gross forward_return_directional forward_return_directional_per_gross forward_return_selection forward_return_selection_per_gross", "SELECT * FROM sections")
def return_attribution(spark, sf_dir):
    return signal.cross_sections(panel_of(spark, sf_dir))


@query(f"{AT} | long_gross_weight long_hit_weighted long_forward_return_per_gross short_gross_weight short_hit_weighted short_forward_return_per_gross", "SELECT * FROM sections")
def long_short_hit(spark, sf_dir):
    return signal.cross_sections(panel_of(spark, sf_dir))


@query("t_idx:int asset_idx:int decile:int | weight forward", "SELECT * FROM ranked")
def decile_assign(spark, sf_dir):
    panel = panel_of(spark, sf_dir)
    return signal.with_deciles(signal.active(signal.forward_returns(panel)), ["run_id", "t_idx"], ranking.is_wide(panel))


@query("t_idx:int asset_idx:int decile:int | weight forward", "SELECT * FROM ranked")
def decile_assign_wide(spark, sf_dir):
    """The same as a market of many assets has it: each period's assets ranked by ranges."""
    return signal.with_deciles(signal.active(signal.forward_returns(panel_of(spark, sf_dir))), ["run_id", "t_idx"], wide=True)


@query(f"{AT} | top_bottom_spread", "SELECT * FROM sections")
def decile_spread(spark, sf_dir):
    return signal.cross_sections(panel_of(spark, sf_dir))


@query("decile:int count:bigint | mean median std contrib contrib_long contrib_short", oracle.DECILES)
def decile_curves(spark, sf_dir):
    return signal.decile_curves(panel_of(spark, sf_dir))


@query("lag:int | total_mean total_tstat selection_mean selection_tstat directional_mean directional_tstat", oracle.ALPHA_DECAY)
def alpha_decay(spark, sf_dir):
    return signal.alpha_decay(panel_of(spark, sf_dir))


@query("horizon:int | ic_mean ic_tstat rank_ic_mean rank_ic_tstat decile_spread_mean decile_spread_tstat", oracle.HORIZON_DECAY)
def horizon_decay(spark, sf_dir):
    return signal.horizon_decay(panel_of(spark, sf_dir), oracle.HORIZONS)


@query("asset_idx:int asset n:bigint | ic_mean hit_rate avg_abs_weight alpha_contribution alpha_contribution_pct", oracle.BY_ASSET)
def signal_by_asset(spark, sf_dir):
    return signal.by_assets(panel_of(spark, sf_dir))


@query(f"{AT} | ic_mean ic_tstat rank_ic_mean rank_ic_tstat decile_spread_mean decile_spread_tstat", oracle.ROLLING_SIGNAL)
def signal_rolling(spark, sf_dir):
    return signal.rolling(signal.cross_sections(panel_of(spark, sf_dir)), 24)


@query("| slope intercept", "SELECT regr_slope(forward_return_per_gross, directionality) AS slope, regr_intercept(forward_return_per_gross, directionality) AS intercept FROM sections")
def directionality_fit(spark, sf_dir):
    return signal.cross_sections(panel_of(spark, sf_dir)).agg(F.regr_slope("forward_return_per_gross", "directionality").alias("slope"), F.regr_intercept("forward_return_per_gross", "directionality").alias("intercept"))


def _changed(spark, sf_dir):
    return panel_of(spark, sf_dir).withColumn("_c", ratio(F.col("close"), F.lag("close").over(by_asset())) - 1)


@query(f"{CELL} | ewma", oracle.ewma(oracle.SPAN_DECAY, 1))
def ewma_signal(spark, sf_dir):
    """The change in price as ewm(span=12, adjust=False) smooths it."""
    return smoothing.ewma(_changed(spark, sf_dir), "_c", "ewma", oracle.SPAN_DECAY)


@query(f"{CELL} | ewma", oracle.ewma(oracle.DECAY, oracle.LEAST_PERIODS))
def ewma_whole(spark, sf_dir):
    """The same with a decay and a least number of known periods."""
    return smoothing.ewma(_changed(spark, sf_dir), "_c", "ewma", oracle.DECAY, oracle.LEAST_PERIODS)


def _grid_panel(spark, sf_dir):
    base = panel_of(spark, sf_dir)
    runs = spark.createDataFrame(oracle.GRID, "run_id string, lookback int, power double")
    own = base.drop("run_id").join(F.broadcast(runs))
    across, along = Window.partitionBy("run_id", "t_idx"), Window.partitionBy("run_id", "asset_idx").orderBy("t_idx")
    past = F.lit(None).cast("double")
    for k in sorted({r[1] for r in oracle.GRID}):
        past = F.when(F.col("lookback") == k, F.lag("close", k).over(along)).otherwise(past)
    change = ratio(F.col("close"), past) - 1
    own = own.withColumn("_m", F.signum(change) * F.pow(F.abs(change), F.col("power")))
    own = own.withColumn("_z", ratio(F.col("_m") - F.avg("_m").over(across), F.stddev_samp("_m").over(across)))
    own = own.withColumn("_z", F.when(F.col("_z").isNotNull(), F.greatest(F.least("_z", F.lit(3.0)), F.lit(-3.0))))
    own = own.withColumn("_w", ratio(F.col("_z"), F.sum(F.abs("_z")).over(across)))
    return own.withColumn("weight", F.lag("_w").over(along)).select(*base.columns)


def _grid_table(spark, sf_dir):
    """All combinations in one job: each is a run of one panel."""
    own = written(replay.replay(_grid_panel(spark, sf_dir), CONFIG), "replayed")
    found = metrics.period_facts(replay.periods(own), CONFIG, tail=False).select("run_id", F.col("sharpe").alias("objective_value"))
    runs = spark.createDataFrame([(r, 0, "lookback x power", k, a, b) for k, (r, a, b) in enumerate(oracle.GRID)], "run_id string, grid_index int, grid_name string, position int, lookback int, power double")
    return runs.join(found, "run_id", "left")


@query("run_id grid_index:int lookback:int | power objective_value", oracle.GRID_SQL)
def grid_table(spark, sf_dir):
    return _grid_table(spark, sf_dir)


@query("run_id lookback:int | power objective_value", f"{oracle.GRID_SQL} ORDER BY objective_value DESC NULLS LAST, position LIMIT 1")
def grid_best(spark, sf_dir):
    return grid.first_best(_grid_table(spark, sf_dir))


def _inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, MarketData]:
    """The panel, its weights and its market as a user has them: long tables (ts, asset, value)."""
    panel = panel_of(spark, sf_dir)
    side = lambda c: panel.select("ts", "asset", F.col(c).alias("value"))
    return panel, side("weight"), MarketData(side("close"), side("exec"), side("funding"))


def _searched(spark, sf_dir) -> grid.GridSearchResults:
    """grid_search() over a grid of two parameters and one of one."""
    panel, _, sides = _inputs(spark, sf_dir)

    def weights(p):
        return market.with_momentum(panel, p["lookback"], p.get("power", 1.0)).select("ts", "asset", F.col("weight").alias("value"))

    return grid.grid_search(generate_weights=weights, objective_metric=grid.Metrics.SHARPE, param_grids=GRIDS, market=sides, config=CONFIG, spark=spark)


GRIDS = [{"lookback": [1, 3, 6], "power": [0.5, 1.0]}, {"lookback": [3, 1]}]
SEARCH_COLUMNS = "grid_index:int grid_name position:int param1_value:bigint param2_value:double param_value:bigint | objective_value"


@query(SEARCH_COLUMNS, oracle.SEARCHED)
def grid_searched(spark, sf_dir):
    return _searched(spark, sf_dir).table


def _momentum(prices, params):
    """The signal of market.with_momentum in pandas, for some of the assets."""
    change = prices / prices.shift(params["lookback"]) - 1
    return (change > 0).astype(float).where(change > 0, -1.0).where(change != 0, 0.0).where(change.notna()) * change.abs() ** params.get("power", 1.0)


@query(SEARCH_COLUMNS, oracle.SEARCHED)
def grid_searched_on_executors(spark, sf_dir):
    """The same search with a pandas callable that runs on the executors for some assets and combinations at a time, and a step across assets."""
    _, _, sides = _inputs(spark, sf_dir)
    weights = ByAsset(_momentum, lambda found: market.standardized(found.withColumnRenamed("weight", "_m"), "_m").select("run_id", "t_idx", "asset_idx", "weight"), 10, 3)
    return grid.grid_search(generate_weights=weights, objective_metric=grid.Metrics.SHARPE, param_grids=GRIDS, market=sides, config=CONFIG, spark=spark).table


@query("| objective_value", f"SELECT * FROM ({oracle.SEARCHED}) ORDER BY objective_value DESC NULLS LAST, grid_index, position LIMIT 5")
def grid_top(spark, sf_dir):
    return _searched(spark, sf_dir).top(5)


@query("grid_index:int grid_name count:bigint | mean std min max", f"SELECT grid_index, grid_name, count(objective_value) AS count, avg(objective_value) AS mean, stddev_samp(objective_value) AS std, min(objective_value) AS min, max(objective_value) AS max FROM ({oracle.SEARCHED}) GROUP BY ALL")
def grid_summary(spark, sf_dir):
    return _searched(spark, sf_dir).summary()


@query("lookback:int | at_half at_one", f"SELECT lookback, max(objective_value) FILTER (power = 0.5) AS at_half, max(objective_value) FILTER (power = 1.0) AS at_one FROM ({oracle.GRID_SQL}) GROUP BY lookback")
def grid_pivot(spark, sf_dir):
    return _searched(spark, sf_dir).pivot(grid_index=0).withColumnsRenamed({"0.5": "at_half", "1.0": "at_one"})


@query("lookback:int | objective_value", f"SELECT param_value AS lookback, objective_value FROM ({oracle.SEARCHED}) WHERE grid_index = 1")
def grid_of_one(spark, sf_dir):
    return _searched(spark, sf_dir).for_grid(1).withColumnRenamed("param_value", "lookback")


def _simulated(spark, sf_dir) -> results.SimulationResult:
    _, weights, sides = _inputs(spark, sf_dir)
    return simulate(weights=weights, market=sides, config=CONFIG, spark=spark)


@query(f"{CELL} | weight close exec funding", "SELECT * FROM panel")
def panel_from_frames(spark, sf_dir):
    _, weights, sides = _inputs(spark, sf_dir)
    return frames.market_panel(spark, weights, sides)


@query(f"{CELL} | close exec funding", "SELECT * FROM panel")
def panel_from_feather(spark, sf_dir):
    """The panel written as Feather files and read back, the columns that are asked for alone."""
    path = feather.write_feather(panel_of(spark, sf_dir))
    return feather.read_feather(spark, path, ["t_idx", "ts", "asset", "asset_idx", "close", "exec", "funding"])


@query(f"{AT} | equity", f"SELECT *, {oracle.INIT} * product(1 + ret) OVER (ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS equity FROM (SELECT * EXCLUDE (equity) FROM periods)")
def compounded_equity(spark, sf_dir):
    """Equity from returns alone, as a report shows it where a result has no equity."""
    return curves.compounded(periods_kept(spark, sf_dir).drop("equity"), oracle.INIT)


@query(f"{CELL} | weight close exec funding", "SELECT * FROM panel")
def panel_from_wide(spark, sf_dir):
    """The same panel from tables that are wide: a column for each brand."""
    panel = panel_of(spark, sf_dir)
    brands = [r["asset"] for r in panel.select("asset").distinct().orderBy("asset").collect()]
    wide = lambda c: panel.groupBy("ts").pivot("asset", brands).agg(F.first(c))
    return frames.market_panel(spark, wide("weight"), MarketData(wide("close"), wide("exec"), wide("funding")))


@query("ordinal:int category metric | value_double", oracle.tall([(k, m[0], m[1], m[2]) for k, m in enumerate(metrics.METRICS) if m[0] not in ("Meta",)]))
def simulated_metrics(spark, sf_dir):
    """simulate()'s own table of metrics."""
    return _simulated(spark, sf_dir).metrics.filter(F.col("category") != "Meta")


@query(f"{AT} | equity_pct returns_pct drawdown_pct transaction_costs long_exposure short_exposure concentration", f"SELECT *, (p.equity / {oracle.INIT} - 1) * 100 AS equity_pct, p.ret * 100 AS returns_pct, d.drawdown * 100 AS drawdown_pct, coalesce((p.fees + p.slippage) / nullif(p.equity, 0), 0) AS transaction_costs, p.t_idx AS t_idx, p.ts AS ts FROM periods p JOIN exposures USING (run_id, t_idx) JOIN (SELECT run_id, t_idx, drawdown FROM drawdowns) d USING (run_id, t_idx)")
def simulated_series(spark, sf_dir):
    """The series of simulate()'s artifacts."""
    return _simulated(spark, sf_dir).artifacts.table


@query(f"{AT} | ic rank_ic decile_spread directionality forward_return_per_gross long_hit_rate short_hit_rate gross_weight", "SELECT *, top_bottom_spread AS decile_spread, long_hit_weighted AS long_hit_rate, short_hit_weighted AS short_hit_rate FROM sections")
def signal_series(spark, sf_dir):
    """The eight series of simulate()'s signal artifacts, side by side."""
    found = _simulated(spark, sf_dir).artifacts.signal
    return reduce(lambda a, b: a.join(b, ["run_id", "t_idx", "ts"]), (getattr(found, name) for name in found.SERIES))


@query("t_idx:int asset | close", oracle.SYNTHETIC)
def synthetic_market(spark, sf_dir):
    """The synthetic market of 500 periods and 50 assets that the benchmark's shapes are run on."""
    close = synthetic.synthetic_prices(spark)
    return close.select(F.datediff("ts", F.lit("2020-01-01").cast("timestamp_ntz")).alias("t_idx"), "asset", F.col("value").alias("close"))


def _fold_panel(spark, sf_dir):
    panel = panel_of(spark, sf_dir)
    return written(folds.with_folds(panel, folds.zoned_boundaries(*folds.span_of(panel), "1YE"), 3), "folds")


def _fold_facts(spark, sf_dir):
    panel = _fold_panel(spark, sf_dir)
    own = written(replay.replay(panel, CONFIG), "replayed")
    found = metrics.period_facts(replay.periods(own), CONFIG, tail=False).select("run_id", "total_return_pct", "sharpe", "max_drawdown_pct", "fees_paid")
    return folds.fold_rows(panel).join(found, "run_id")


_FOLD_METRICS = {"Total return %": "total_return_pct", "Annualized Sharpe": "sharpe", "Max drawdown (equity) %": "max_drawdown_pct", "Fees": "fees_paid"}


def _walked(spark, sf_dir) -> folds.WalkForwardResult:
    _, weights, sides = _inputs(spark, sf_dir)
    return folds.walk_forward(weights=weights, market=sides, config=CONFIG, fold_config=FoldConfig("1YE"), metrics_to_aggregate=list(_FOLD_METRICS), include_full_result=False, spark=spark)


@query("fold_index:int start_period end_period n_periods:bigint", oracle.FOLD_ROWS)
def fold_boundaries(spark, sf_dir):
    return folds.fold_rows(_fold_panel(spark, sf_dir))


@query("fold_index:int | total_return_pct sharpe max_drawdown_pct fees_paid", oracle.FOLD_FACTS)
def fold_metrics(spark, sf_dir):
    return _fold_facts(spark, sf_dir)


@query("metric count:bigint | median mean std min max", oracle.FOLD_AGGREGATION)
def fold_aggregation(spark, sf_dir):
    names = ["total_return_pct", "sharpe", "max_drawdown_pct", "fees_paid"]
    tall = _fold_facts(spark, sf_dir).unpivot(["run_id"], names, "metric", "value_double")
    return folds.aggregated(tall, names)


@query("fold_index:int start_period end_period n_periods:bigint | total_return_pct sharpe max_drawdown_pct fees_paid", f"SELECT * FROM ({oracle.FOLD_ROWS}) JOIN ({oracle.FOLD_FACTS}) USING (fold_index)")
def fold_summary(spark, sf_dir):
    return _walked(spark, sf_dir).summary.withColumnsRenamed(_FOLD_METRICS)


@query("metric count:bigint | median mean std min max", oracle.FOLD_AGGREGATION)
def fold_stats(spark, sf_dir):
    """walk_forward()'s own statistics."""
    stats = _walked(spark, sf_dir).summary_stats().rename(columns=str.lower).replace({"metric": _FOLD_METRICS})
    return spark.createDataFrame(stats)

"""Time series of a run: drawdown, rolling Sharpe ratio, benchmark, and what the positions tell for each period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SimConfig
from ..functions.stats import by_asset, by_time, ratio, so_far, trailing

#: Periods of a chunk: what a window over a run's past brings together in one task.
CHUNK = 100_000


def _chunked(rows: DataFrame, chunk: int) -> DataFrame:
    return rows.withColumn("_chunk", F.floor(F.col("t_idx") / chunk).cast("int"))


def with_drawdown(periods: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds peak (the highest equity so far) and drawdown (equity over it, less 1). A run is scanned in two levels: chunks of periods give their maxima, of which a row each is scanned in order, and each chunk starts from what those before it reached."""
    rows = _chunked(periods, chunk)
    carried = F.max("_most").over(Window.partitionBy("run_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    tops = rows.groupBy("run_id", "_chunk").agg(F.max("equity").alias("_most")).select("run_id", "_chunk", carried.alias("_carried"))
    own = F.max("equity").over(so_far(Window.partitionBy("run_id", "_chunk").orderBy("t_idx")))
    out = rows.join(tops, ["run_id", "_chunk"]).withColumn("peak", F.greatest("_carried", own))
    return out.withColumn("drawdown", ratio(F.col("equity"), F.col("peak")) - 1).select(*periods.columns, "peak", "drawdown")


def compounded(periods: DataFrame, init_cash: float, chunk: int = CHUNK) -> DataFrame:
    """Adds equity as the running product of 1 and each return, from init_cash on; a missing return changes nothing. A product over each chunk, and one over the chunks before it: returns of -1 and below are factors like any others."""
    rows = _chunked(periods, chunk).withColumn("_grown", 1 + F.coalesce("ret", F.lit(0.0)))
    along = Window.partitionBy("run_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    grown = rows.groupBy("run_id", "_chunk").agg(F.product("_grown").alias("_all")).select("run_id", "_chunk", F.coalesce(F.product("_all").over(along), F.lit(1.0)).alias("_before"))
    own = F.product("_grown").over(so_far(Window.partitionBy("run_id", "_chunk").orderBy("t_idx")))
    return rows.join(grown, ["run_id", "_chunk"]).withColumn("equity", init_cash * F.col("_before") * own).select(*periods.columns, "equity")


def rolling_sharpe(periods: DataFrame, config: SimConfig, window: int = 30, least: int = 6) -> DataFrame:
    """(run_id, t_idx, ts, rolling_sharpe): mean over deviation of the excess returns in the window, annualised; null for fewer than least periods and without deviation."""
    excess = F.col("ret") - config.period_risk_free
    w = trailing(window)
    varied = (F.count("ret").over(w) >= least) & (F.min("ret").over(w) < F.max("ret").over(w))
    return periods.select("run_id", "t_idx", "ts", F.when(varied, ratio(F.avg(excess).over(w), F.stddev_samp(excess).over(w)) * config.annual_factor**0.5).alias("rolling_sharpe"))


def smoothed(series: DataFrame, column: str, window: int) -> DataFrame:
    """The column's trailing mean, over at least max(3, window // 5) values; as it is for a window of at most 1."""
    if window <= 1:
        return series
    w = trailing(window)
    return series.withColumn(column, F.when(F.count(column).over(w) >= max(3, window // 5), F.avg(column).over(w)))


def benchmark(panel: DataFrame, config: SimConfig) -> DataFrame:
    """(run_id, t_idx, ts, price, benchmark_ret, benchmark_equity) of the benchmark asset's close, gaps filled from before and else from after, within the run."""
    own = panel.filter(F.col("asset") == F.lit(config.benchmark_asset)).select("run_id", "t_idx", "ts", "close")
    before, after = by_time().rowsBetween(Window.unboundedPreceding, 0), by_time().rowsBetween(0, Window.unboundedFollowing)
    filled = own.withColumn("price", F.coalesce(F.last("close", True).over(before), F.first("close", True).over(after)))
    first = F.first("price").over(by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    change = F.coalesce(ratio(F.col("price"), F.lag("price").over(by_time())) - 1, F.lit(0.0))
    return filled.select("run_id", "t_idx", "ts", "price", change.alias("benchmark_ret"), (config.init_cash * ratio(F.col("price"), first)).alias("benchmark_equity"))


def exposures(positions: DataFrame) -> DataFrame:
    """(run_id, t_idx, long_exposure, short_exposure, concentration, and the same by notional): the first three are made of units, the others of close values, which is what their names promise."""
    def sums(x: str, suffix: str) -> list:
        positive, negative, size = (F.sum(F.greatest(F.col(x), F.lit(0.0))), F.sum(F.least(F.col(x), F.lit(0.0))), F.sum(F.abs(x)))
        equity = F.max("equity")
        share = F.coalesce(ratio(F.sum(F.col(x) * F.col(x)), size * size), F.lit(0.0))
        return [F.coalesce(ratio(positive, equity), F.lit(0.0)).alias(f"long_exposure{suffix}"), F.coalesce(ratio(negative, equity), F.lit(0.0)).alias(f"short_exposure{suffix}"), share.alias(f"concentration{suffix}")]

    return positions.groupBy("run_id", "t_idx", "ts").agg(*sums("units", ""), *sums("close_value", "_notional"))


def weight_counts(panel: DataFrame) -> DataFrame:
    """(run_id, t_idx, n_positions): assets with a target weight over 1e-8."""
    return panel.groupBy("run_id", "t_idx").agg(F.count_if(F.abs("weight") > 1e-8).alias("n_positions"))


def artifacts(periods: DataFrame, positions: DataFrame, panel: DataFrame) -> DataFrame:
    """All series of a run in one table: those of periods with drawdown, transaction_costs, exposures and n_positions."""
    costs = F.coalesce(ratio(F.col("fees") + F.col("slippage"), F.col("equity")), F.lit(0.0))
    return with_drawdown(periods).withColumn("transaction_costs", costs).join(exposures(positions).drop("ts"), ["run_id", "t_idx"]).join(weight_counts(panel), ["run_id", "t_idx"])


def island_lengths(rows: DataFrame, keys: list[str], state: str, chunk: int = CHUNK) -> DataFrame:
    """(keys, state, start, length) of each stretch of equal states in time.

    Stretches are found in chunks of periods first. Only the first and the last one of a chunk can go on in the next one: those,
    two a chunk, are joined in order, and all others are whole already.
    """
    own = _chunked(rows.select(*keys, "t_idx", state), chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy("t_idx")
    marked = own.withColumn("_new", F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    pieces = marked.withColumn("_piece", F.sum("_new").over(so_far(w))).groupBy(*keys, "_chunk", "_piece").agg(F.first(state).alias(state), F.min("t_idx").alias("start"), F.count(F.lit(1)).alias("length"))
    last = F.max("_piece").over(Window.partitionBy(*keys, "_chunk"))
    pieces = pieces.withColumn("_edge", (F.col("_piece") == 1) | (F.col("_piece") == last))
    along = Window.partitionBy(*keys).orderBy("start")
    goes_on = F.col(state).eqNullSafe(F.lag(state).over(along)) & (F.lag("_chunk").over(along) + 1 == F.col("_chunk")) & (F.lag("_piece").over(along) == F.lag("_last").over(along)) & (F.col("_piece") == 1)
    edges = pieces.withColumn("_last", last).filter("_edge").withColumn("_new", F.when(goes_on, 0).otherwise(1))
    joined = edges.withColumn("_island", F.sum("_new").over(so_far(along))).groupBy(*keys, "_island").agg(F.first(state).alias(state), F.min("start").alias("start"), F.sum("length").alias("length"))
    return pieces.filter("not _edge").select(*keys, state, "start", "length").unionByName(joined.select(*keys, state, "start", "length"))


def drawdown_durations(periods: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(run_id, drawdown_duration): the longest stretch of periods under water."""
    under = with_drawdown(periods, chunk).withColumn("under", F.coalesce(F.col("drawdown") < 0, F.lit(False)))
    return island_lengths(under, ["run_id"], "under", chunk).groupBy("run_id").agg(F.coalesce(F.max(F.when(F.col("under"), F.col("length"))), F.lit(0)).alias("drawdown_duration"))


def recoveries(periods: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(run_id, trough, peak_at, time_to_recovery): from the last period at the peak before the deepest drawdown (the first, if several are as deep) to the first one at or over it again; null if there is none, 0 without a drawdown."""
    marked = with_drawdown(periods, chunk).select("run_id", "t_idx", "equity", "peak", "drawdown")
    trough = marked.groupBy("run_id").agg(F.min(F.struct(F.coalesce("drawdown", F.lit(0.0)).alias("d"), "t_idx", "peak")).alias("at"))
    trough = trough.select("run_id", F.col("at.d").alias("depth"), F.col("at.t_idx").alias("trough"), F.col("at.peak").alias("top"))
    both = marked.select("run_id", "t_idx", "equity").join(trough, "run_id")
    found = both.groupBy("run_id", "depth", "trough").agg(
        F.max(F.when((F.col("t_idx") <= F.col("trough")) & (F.col("equity") == F.col("top")), F.col("t_idx"))).alias("peak_at"),
        F.min(F.when((F.col("t_idx") >= F.col("trough")) & (F.col("equity") >= F.col("top")), F.col("t_idx"))).alias("back_at"),
    )
    return found.select("run_id", "trough", "peak_at", F.when(F.col("depth") >= 0, 0).otherwise(F.col("back_at") - F.col("peak_at")).cast("double").alias("time_to_recovery"))


def holding_periods(positions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(run_id, holding_period): mean length of the stretches in which an asset's position keeps its sign; null if none is ever held."""
    signed = positions.withColumn("side", F.signum("units"))
    stretches = island_lengths(signed, ["run_id", "asset_idx"], "side", chunk).filter("side != 0")
    return stretches.groupBy("run_id").agg(F.avg("length").alias("holding_period"))


"""What weights tell about the returns that follow: cross-sections, deciles, lags, horizons and assets.

An asset is active in a period where its weight is neither null nor 0 and its return is known. A period counts from two active
assets on. Returns are those of raw closes: a gap isn't filled. Where all weights or all returns are equal, a correlation is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_rank, by_asset, correlation, ratio, t_stat, t_stat_over, trailing
from ..sources.written import written
from .ranking import is_wide, ranks
from .selection import quantile

N_DECILES = 10


def forward_returns(panel: DataFrame, horizon: int = 1) -> DataFrame:
    return panel.withColumn("forward", ratio(F.lead("close", horizon).over(by_asset()), F.col("close")) - 1)


def active(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("weight") != 0) & F.col("forward").isNotNull())


def with_deciles(rows: DataFrame, keys: list[str], wide: bool = False) -> DataFrame:
    """Adds n (active assets) and decile, from 0: floor(10 i / n) of the i-th by weight, then by asset; null for fewer than 10. wide: a period has more assets than one task should sort."""
    return _with_decile(_placed(rows, keys, wide)).drop("_at", "weight_rank")


def _placed(rows: DataFrame, keys: list[str], wide: bool) -> DataFrame:
    """Adds n, weight_rank, and _at, the number of assets before by weight, then by asset."""
    if wide:
        return ranks(rows, keys, "weight", "asset_idx", "weight_rank", "_at", "n")
    across = Window.partitionBy(*keys)
    return rows.withColumns({"n": F.count(F.lit(1)).over(across), "_at": F.row_number().over(across.orderBy("weight", "asset_idx")) - 1, "weight_rank": average_rank("weight", keys)})


def _with_decile(placed: DataFrame) -> DataFrame:
    return placed.withColumn("decile", F.when(F.col("n") >= N_DECILES, F.floor(F.col("_at") * N_DECILES / F.col("n")).cast("int")))


def _core(keys: list[str]) -> tuple[Column, Column, Column]:
    """ic, rank_ic and top_bottom_spread over rows with ranks and deciles."""
    edge = lambda d: F.avg(F.when(F.col("decile") == d, F.col("forward")))
    return correlation(F.col("weight"), F.col("forward")).alias("ic"), correlation(F.col("weight_rank"), F.col("forward_rank")).alias("rank_ic"), (edge(N_DECILES - 1) - edge(0)).alias("top_bottom_spread")


def _ranked(rows: DataFrame, keys: list[str], wide: bool) -> DataFrame:
    own = _with_decile(_placed(rows, keys, wide)).drop("_at").filter("n >= 2")
    return ranks(own, keys, "forward", "asset_idx", "forward_rank") if wide else own.withColumn("forward_rank", average_rank("forward", keys))


def cross_sections(panel: DataFrame, wide: bool | None = None) -> DataFrame:
    """One row for each run and period; all measures are null in periods with fewer than two active assets. wide: whether a period has more assets than one task should sort; looked up if None."""
    wide = is_wide(panel) if wide is None else wide
    keys = ["run_id", "t_idx"]
    w, r = F.col("weight"), F.col("forward")
    gross, net, paid = F.sum(F.abs(w)), F.sum(w), F.sum(w * r)
    directional = net * F.avg(r)

    def side(name: str, ours: Column, hits: Column) -> list[Column]:
        own = F.sum(F.when(ours, F.abs(w)))
        return [own.alias(f"{name}_gross_weight"), ratio(F.sum(F.when(ours, F.when(hits, F.abs(w)).otherwise(0.0))), own).alias(f"{name}_hit_weighted"), ratio(F.sum(F.when(ours, w * r)), own).alias(f"{name}_forward_return_per_gross")]

    measured = _ranked(active(forward_returns(panel)), keys, wide).groupBy(*keys).agg(
        *_core(keys), gross.alias("gross_weight"), net.alias("net_weight"), ratio(net, gross).alias("directionality"),
        paid.alias("forward_return"), ratio(paid, gross).alias("forward_return_per_gross"),
        directional.alias("forward_return_directional"), ratio(directional, gross).alias("forward_return_directional_per_gross"),
        (paid - directional).alias("forward_return_selection"), ratio(paid - directional, gross).alias("forward_return_selection_per_gross"),
        *side("long", w > 0, r > 0), *side("short", w < 0, r < 0),
    )
    return panel.select(*keys, "ts").distinct().join(measured, keys, "left")


def decile_curves(panel: DataFrame, wide: bool | None = None) -> DataFrame:
    """(run_id, decile from 1, mean, median, std, count, contrib, contrib_long, contrib_short), pooled over all periods; all ten deciles of each run."""
    keys = ["run_id", "t_idx"]
    w, r = F.col("weight"), F.col("forward")
    rows = written(with_deciles(active(forward_returns(panel)), keys, is_wide(panel) if wide is None else wide).filter("decile is not null").select("run_id", (F.col("decile") + 1).alias("decile"), "weight", "forward"), "deciles")
    share = lambda own: ratio(F.sum(F.when(own, w * r).otherwise(0.0)), F.count(F.lit(1)).cast("double"))
    medians = quantile(rows, ["run_id", "decile"], "forward", 0.5).select("run_id", "decile", F.col("quantile").alias("median"))
    curves = rows.groupBy("run_id", "decile").agg(
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.count(F.lit(1)).alias("count"),
        share(F.lit(True)).alias("contrib"), share(w > 0).alias("contrib_long"), share(w < 0).alias("contrib_short"),
    )
    ladder = panel.select("run_id").distinct().withColumn("decile", F.explode(F.sequence(F.lit(1), F.lit(N_DECILES))))
    return ladder.join(curves, ["run_id", "decile"], "left").join(medians, ["run_id", "decile"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def alpha_decay(panel: DataFrame, max_lag: int = 10) -> DataFrame:
    """(run_id, lag, and mean and t-stat of total, selection and directional return per gross) with weights of so many periods ago; as many lags as the run's periods allow."""
    lags = F.array(*(F.struct(F.lit(k).alias("lag"), (F.lag("weight", k).over(by_asset()) if k else F.col("weight")).alias("weight")) for k in range(max_lag + 1)))
    rows = forward_returns(panel).withColumn("_lags", lags)
    rows = rows.select("run_id", "t_idx", "forward", F.explode("_lags").alias("l")).select("run_id", "t_idx", "forward", "l.lag", "l.weight")
    w, r = F.col("weight"), F.col("forward")
    gross, paid, directional = F.sum(F.abs(w)), F.sum(w * r), F.sum(w) * F.avg(r)
    each = active(rows).groupBy("run_id", "lag", "t_idx").agg(F.count(F.lit(1)).alias("n"), ratio(paid, gross).alias("total"), ratio(paid - directional, gross).alias("selection"), ratio(directional, gross).alias("directional")).filter("n >= 2")
    kinds = ("total", "selection", "directional")
    found = each.groupBy("run_id", "lag").agg(*(f(F.col(k)).alias(f"{k}_{name}") for k in kinds for name, f in (("mean", F.avg), ("tstat", t_stat))))
    last = F.least(F.lit(max_lag), F.greatest(F.lit(0), F.max("t_idx") - 1))
    ladder = panel.groupBy("run_id").agg(last.alias("_last")).select("run_id", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("lag"))
    return ladder.join(found, ["run_id", "lag"], "left")


def horizon_decay(panel: DataFrame, horizons: list[int], wide: bool | None = None) -> DataFrame:
    """(run_id, horizon, and mean and t-stat of ic, rank_ic and decile_spread) of returns over so many periods; horizons as long as the run or longer have no row."""
    ahead = [h for h in sorted(set(horizons)) if h >= 1]
    kinds = (("ic", "ic"), ("rank_ic", "rank_ic"), ("top_bottom_spread", "decile_spread"))
    ladder = panel.groupBy("run_id").agg((F.max("t_idx") + 1).alias("_n")).withColumn("horizon", F.explode(F.array(*map(F.lit, ahead)).cast("array<int>"))).filter("horizon < _n").drop("_n")
    if not ahead:
        return ladder.select("run_id", "horizon", *(F.lit(None).cast("double").alias(f"{b}_{s}") for _, b in kinds for s in ("mean", "tstat")))
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), (ratio(F.lead("close", h).over(by_asset()), F.col("close")) - 1).alias("forward")) for h in ahead))
    rows = panel.withColumn("_ahead", each).select("run_id", "t_idx", "asset_idx", "weight", F.explode("_ahead").alias("h")).select("run_id", "t_idx", "asset_idx", "weight", "h.horizon", "h.forward")
    keys = ["run_id", "horizon", "t_idx"]
    measured = _ranked(active(rows), keys, is_wide(panel) if wide is None else wide).groupBy(*keys).agg(*_core(keys))
    found = measured.groupBy("run_id", "horizon").agg(*(f(F.col(a)).alias(f"{b}_{s}") for a, b in kinds for s, f in (("mean", F.avg), ("tstat", t_stat))))
    return ladder.join(found, ["run_id", "horizon"], "left")


def by_assets(panel: DataFrame, least: int = 3) -> DataFrame:
    """(run_id, asset_idx, asset, n, ic_mean, hit_rate, avg_abs_weight, alpha_contribution, alpha_contribution_pct) of every asset; null for fewer than least active periods. The percentages' sizes add up to 100."""
    w, r = F.col("weight"), F.col("forward")
    found = active(forward_returns(panel)).groupBy("run_id", "asset_idx").agg(
        F.count(F.lit(1)).alias("n"), correlation(w, r).alias("ic_mean"), F.avg((F.signum(w) == F.signum(r)).cast("double")).alias("hit_rate"),
        F.avg(F.abs(w)).alias("avg_abs_weight"), F.sum(w * r).alias("alpha_contribution"),
    ).filter(F.col("n") >= least)
    out = panel.select("run_id", "asset_idx", "asset").distinct().join(found, ["run_id", "asset_idx"], "left")
    whole = F.sum(F.abs("alpha_contribution")).over(Window.partitionBy("run_id"))
    return out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("alpha_contribution_pct", ratio(F.col("alpha_contribution"), whole) * 100)


def rolling(sections: DataFrame, window: int = 90, least: int | None = None) -> DataFrame:
    """(run_id, t_idx, ts, and trailing mean and t-stat of ic, rank_ic and decile_spread): null with fewer than least values in the window, by default a third of it and at least 3. A run shorter than the window has no rows."""
    least, w = least or max(3, window // 3), trailing(window)
    cols = []
    for a, b in (("ic", "ic"), ("rank_ic", "rank_ic"), ("top_bottom_spread", "decile_spread")):
        enough = F.count(a).over(w) >= least
        cols += [F.when(enough, F.avg(a).over(w)).alias(f"{b}_mean"), F.when(enough, t_stat_over(F.col(a), w)).alias(f"{b}_tstat")]
    length = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    return sections.select("run_id", "t_idx", "ts", *cols, length.alias("_length")).filter(F.col("_length") >= window).drop("_length")


def summary(sections: DataFrame, periods: DataFrame, cost_per_turnover: float) -> DataFrame:
    """One row for each run: the signal metrics, by column names of metrics.METRICS."""
    rows = sections.join(periods.select("run_id", "t_idx", "weight_turnover"), ["run_id", "t_idx"])
    cost = F.col("weight_turnover") * cost_per_turnover
    per_gross, selection = F.col("forward_return_per_gross"), F.col("forward_return_selection_per_gross")
    mean = F.avg
    return rows.groupBy("run_id").agg(
        mean("ic").alias("ic_mean"), t_stat(F.col("ic")).alias("ic_tstat"), mean("rank_ic").alias("rank_ic_mean"), t_stat(F.col("rank_ic")).alias("rank_ic_tstat"),
        mean("top_bottom_spread").alias("spread_mean"), t_stat(F.col("top_bottom_spread")).alias("spread_tstat"),
        mean("long_hit_weighted").alias("long_hit_mean"), mean("short_hit_weighted").alias("short_hit_mean"),
        mean(per_gross).alias("per_gross_mean"), mean(selection).alias("selection_mean"), t_stat(selection).alias("selection_tstat"),
        mean("gross_weight").alias("gross_weight_mean"), mean("directionality").alias("directionality_mean"),
        mean(F.col("ic") * (1 - cost)).alias("adjusted_ic_mean"), mean(per_gross - cost).alias("net_per_gross_mean"),
    )

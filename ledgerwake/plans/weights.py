"""Weights of many combinations of parameters, made on the executors."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio


def gross_scaled(weights: DataFrame) -> DataFrame:
    """Weights by the sum of their sizes in the period; 0 where there is none."""
    gross = F.sum(F.abs("weight")).over(Window.partitionBy("run_id", "t_idx"))
    return weights.withColumn("weight", F.coalesce(ratio(F.col("weight"), gross), F.lit(0.0)))


@dataclass(frozen=True)
class ByAsset:
    """A callable for grid_search that looks at each asset's own prices.

    function(prices, params) gets the closes of some of the assets as a wide pandas frame and gives a frame of the same periods
    and assets. across, if there is one, is applied to all of them as a DataFrame (run_id, t_idx, asset_idx, weight), for what a
    period's assets have to do with each other, as gross_scaled does.

    Combinations are rows: each task runs the callable for some assets and some combinations, so that neither the driver nor
    the plan knows how many there are, and a task holds the prices of assets_at_once assets.
    """

    function: Callable[[pd.DataFrame, Mapping[str, Any]], pd.DataFrame]
    across: Callable[[DataFrame], DataFrame] | None = None
    assets_at_once: int = 64
    combinations_at_once: int = 16

    def weights(self, cells: DataFrame, combinations: Mapping[str, Mapping[str, Any]]) -> DataFrame:
        """(run_id, t_idx, asset_idx, weight) of each combination by its run_id, from cells (t_idx, ts, asset, asset_idx, close)."""
        named, at_once, function = list(combinations.items()), self.combinations_at_once, self.function
        shares = [named[k : k + at_once] for k in range(0, len(named), at_once)]

        def made(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            prices = frame.pivot(index="t_idx", columns="asset_idx", values="close").sort_index()
            periods, assets = prices.index, prices.columns
            times = frame.drop_duplicates("t_idx").set_index("t_idx")["ts"].reindex(periods)
            names = frame.drop_duplicates("asset_idx").set_index("asset_idx")["asset"].reindex(assets)
            prices = prices.astype(float).set_axis(pd.DatetimeIndex(times), axis=0).set_axis(list(names), axis=1)
            out = []
            for run_id, params in shares[key[1]]:
                own = function(prices.copy(), dict(params))
                if own.shape != prices.shape or list(own.columns) != list(prices.columns) or not own.index.equals(prices.index):
                    raise ValueError("weights must have the periods and assets of the prices that they are made of")
                tall = own.astype(float).set_axis(periods, axis=0).set_axis(assets, axis=1).rename_axis("t_idx").reset_index().melt("t_idx", var_name="asset_idx", value_name="weight")
                out.append(tall.assign(run_id=run_id))
            return pd.concat(out)[["run_id", "t_idx", "asset_idx", "weight"]]

        own = cells.select("t_idx", "ts", "asset", "asset_idx", "close", F.floor(F.col("asset_idx") / self.assets_at_once).cast("int").alias("_assets"))
        dealt = own.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1))))
        found = dealt.groupBy("_assets", "_share").applyInPandas(made, "run_id string, t_idx int, asset_idx int, weight double")
        found = found.withColumn("weight", F.when(~F.isnan("weight"), F.col("weight")))
        return self.across(found) if self.across else found

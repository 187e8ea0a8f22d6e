"""Long panels from DataFrames or from wide pandas frames.

A panel has one row for each run, period and asset: run_id, t_idx, ts, asset, asset_idx, weight, close, exec, funding. NaN and
infinite values are null in it.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MarketData
from ..functions.stats import finite
from ..functions.zones import with_zone
from .written import observed

PANEL = ["run_id", "t_idx", "ts", "asset", "asset_idx", "weight", "close", "exec", "funding"]


def long_frame(spark: SparkSession, x: Any, name: str) -> DataFrame:
    """(ts, asset, <name>, and asset_order where x is wide) of a long DataFrame (ts, asset, value), or of a wide one or a wide pandas frame: ts, or the index, and a column for each asset. A series is one asset, named by itself or else by name."""
    if isinstance(x, DataFrame) and not {"asset", "value"} <= set(x.columns):
        return _unpivoted(x, name)
    if isinstance(x, DataFrame):
        extra = ["asset_order"] if "asset_order" in x.columns else []
        return x.select("ts", "asset", F.col("value").alias(name), *extra)
    frame = x.to_frame(x.name or name) if isinstance(x, pd.Series) else x
    if not isinstance(frame.index, pd.DatetimeIndex):
        raise ValueError(f"{name} must have a DatetimeIndex")
    if not len(frame.columns):
        raise ValueError(f"{name} must have at least one asset")
    if name == "close" and not all(pd.api.types.is_float_dtype(t) for t in frame.dtypes):
        raise ValueError("close_prices must be floats")
    order = {str(c): k for k, c in enumerate(frame.columns)}
    tall = frame.astype(float).set_axis(list(order), axis=1).rename_axis("ts").reset_index().melt("ts", var_name="asset", value_name=name)
    tall["asset_order"] = tall["asset"].map(order)
    kind = "timestamp" if frame.index.tz is not None else "timestamp_ntz"
    return spark.createDataFrame(tall[["ts", "asset", name, "asset_order"]], f"ts {kind}, asset string, {name} double, asset_order int")


def _unpivoted(x: DataFrame, name: str) -> DataFrame:
    """A wide DataFrame as a long one; columns keep their order. Rows are not shuffled."""
    assets = [c for c in x.columns if c != "ts"]
    if not assets or "ts" not in x.columns:
        raise ValueError(f"{name} must have a column ts and at least one asset")
    cells = x.select("ts", F.posexplode(F.array(*(F.col(f"`{c}`") for c in assets))).alias("asset_order", name))
    return cells.select("ts", F.element_at(F.array(*map(F.lit, assets)), F.col("asset_order") + 1).alias("asset"), name, "asset_order")


def market_panel(spark: SparkSession, weights: Any, market: MarketData) -> DataFrame:
    """The panel of one run, "run". All tables must hold the same periods and assets, each pair once: else a ValueError. Assets are ordered as the columns of close_prices, or by name."""
    close = long_frame(spark, market.close_prices, "close")
    if not isinstance(market.close_prices, (pd.DataFrame, pd.Series)) and dict(close.dtypes)["close"] not in ("double", "float"):
        raise ValueError("close_prices must be floats")
    single = isinstance(market.close_prices, pd.Series)
    sides = [("exec", market.exec_prices), ("weight", weights), *([("funding", market.funding_rates)] if market.funding_rates is not None else [])]
    no_order = F.lit(None).cast(dict(close.dtypes).get("asset_order", "int"))
    order = F.col("asset_order") if "asset_order" in close.columns else no_order
    rows = close.select("ts", "asset", F.lit("close").alias("side"), F.col("close").cast("double").alias("value"), order.alias("asset_order"))
    for name, x in sides:
        side = long_frame(spark, x, name)
        if single and isinstance(x, pd.Series):
            side = side.withColumn("asset", F.lit(str(market.close_prices.name or "close")))
        rows = rows.unionByName(side.select("ts", "asset", F.lit(name).alias("side"), F.col(name).cast("double").alias("value"), no_order.alias("asset_order")))
    names = ["close", *(n for n, _ in sides)]
    cells, index = _cells_and_index(rows, names)
    cells = with_zone(cells, market.time_zone or index_zone(market.close_prices))
    if "funding" not in names:
        cells = cells.withColumn("funding", F.lit(0.0))
    periods = index.filter("of_asset = 0").select("ts", F.col("number").alias("t_idx"))
    assets = index.filter("of_asset = 1").select("asset", F.col("number").alias("asset_idx"))
    values = [finite(F.col(c).cast("double")).alias(c) for c in ("weight", "close", "exec", "funding")]
    return cells.join(periods, "ts").join(assets, "asset").select(F.lit("run").alias("run_id"), "t_idx", "ts", "asset", "asset_idx", *values)


def _cells_and_index(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The dense cells (ts, asset, a column for each name) and the numbers of their periods and assets (of_asset, ts, asset, number), both written. That every table has every cell once is observed while they are written, so that no job is there to check it.

    Only the distinct periods and the distinct assets, which grow with neither's product, are numbered in one task each.
    """
    of = lambda n: F.when(F.col("side") == n, F.col("value"))
    times = lambda n: F.count_if(F.col("side") == n)
    # one grouping of all tables: each must hold each cell once
    cells = rows.groupBy("ts", "asset").agg(*(F.max(of(n)).alias(n) for n in names), F.min("asset_order").alias("asset_order"), *(times(n).alias(f"_in_{n}") for n in names))
    lacking = F.coalesce(*(F.when(F.col(f"_in_{n}") == 0, n) for n in names))
    repeated = F.greatest(*(F.col(f"_in_{n}") for n in names))
    cells, state = observed(cells, "cells", ["ts", "asset", "asset_order", *names], n=F.count(F.lit(1)), lacking=F.max(lacking), most=F.max(repeated))
    kinds = cells.groupingSets([["ts"], ["asset"]], "ts", "asset").agg(F.grouping("ts").cast("int").alias("of_asset"), F.min("asset_order").alias("_order"))
    number = F.row_number().over(Window.partitionBy("of_asset").orderBy("ts", "_order", "asset")) - 1
    # the order of a period's assets says nothing of the period: ts comes first there, and is null for all assets
    index, seen = observed(kinds.withColumn("number", number.cast("int")), "index", ["of_asset", "ts", "asset", "number"], **{f"n_{k}": F.count_if(F.col("of_asset") == k) for k in (0, 1)})
    if state["lacking"]:
        raise ValueError(f"all tables must have the same periods and assets; {state['lacking']} differs")
    if state["n"] and (state["most"] > 1 or state["n"] != seen["n_0"] * seen["n_1"]):
        raise ValueError("each period must hold each asset once")
    if (seen["n_0"] or 0) < 3:
        raise ValueError("at least 3 periods are needed")
    return cells.drop("asset_order"), index


def index_zone(x: Any) -> str | None:
    """The name of a pandas index's time zone."""
    zone = getattr(getattr(x, "index", None), "tz", None)
    return None if zone is None else str(zone)

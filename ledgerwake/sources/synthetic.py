"""A synthetic market of any size: prices from normal returns that are hashed from the seed, the asset and the period, so that each cell is the same on every run and however the work is dealt."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MarketData
from ..functions.stats import ratio


def _unit(*key: Column) -> Column:
    """A number above 0 and up to 1 from the first 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in key)).cast("binary")), 1, 13), 16, 10).cast("long").cast("double")
    return (bits + 1) / float(1 << 52)


def synthetic_prices(spark: SparkSession, n_periods: int = 500, n_assets: int = 50, seed: int = 42, mean: float = 0.0005, deviation: float = 0.02) -> DataFrame:
    """(ts, asset, value, asset_order): daily prices from 2020-01-01 on, a running product of 100 and 1 plus a normal return."""
    cells = spark.range(n_periods * n_assets).select((F.col("id") / n_assets).cast("int").alias("t"), (F.col("id") % n_assets).cast("int").alias("asset_order"))
    key = F.lit(seed), F.col("asset_order"), F.col("t")
    normal = F.sqrt(-2 * F.log(_unit(*key, F.lit(0)))) * F.cos(2 * pi * _unit(*key, F.lit(1)))
    so_far = Window.partitionBy("asset_order").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    price = 100 * F.exp(F.sum(F.log(1 + mean + deviation * normal)).over(so_far))
    ts = F.timestamp_add("DAY", F.col("t"), F.lit("2020-01-01").cast("timestamp_ntz"))
    return cells.select(ts.alias("ts"), F.concat(F.lit("ASSET_"), F.col("asset_order")).alias("asset"), price.alias("value"), "asset_order")


def synthetic_market(spark: SparkSession, n_periods: int = 500, n_assets: int = 50, seed: int = 42) -> MarketData:
    """Orders execute at the close, and nothing is funded."""
    close = synthetic_prices(spark, n_periods, n_assets, seed)
    return MarketData(close, close)


def momentum_weights(close: DataFrame, lookback: int, power: float = 1.0) -> DataFrame:
    """(ts, asset, value): the change over lookback periods, its size to a power, by the sum of sizes of the period; 0 where there is none."""
    own, across = Window.partitionBy("asset").orderBy("ts"), Window.partitionBy("ts")
    change = F.coalesce(ratio(F.col("value"), F.lag("value", lookback).over(own)) - 1, F.lit(0.0))
    raw = close.select("ts", "asset", (F.signum(change) * F.pow(F.abs(change), F.lit(float(power)))).alias("raw"))
    return raw.select("ts", "asset", F.coalesce(ratio(F.col("raw"), F.sum(F.abs("raw")).over(across)), F.lit(0.0)).alias("value"))

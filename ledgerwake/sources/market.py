"""A market panel out of an order book of line items: the monthly price of each brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import finite, ratio
from .frames import PANEL
from .written import written


def monthly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t_idx, ts, asset, asset_idx, close, funding) of all months and brands: the month's revenue by unit, and its mean discount over 5 %, in hundredths. A month without sales of the brand has nulls. The sales are read once: their months are written, and all that follows reads those. Months and brands are numbered before they are crossed."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("asset"))
    sold = items.join(parts, items.l_partkey == parts.p_partkey).groupBy("ts", "asset").agg(
        ratio(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"), ((F.avg("l_discount") - 0.05) / 100).alias("funding")
    )
    sold = written(sold, "monthly")
    number = lambda c, into: sold.select(c).distinct().withColumn(into, (F.row_number().over(Window.orderBy(c)) - 1).cast("int"))
    return number("ts", "t_idx").crossJoin(number("asset", "asset_idx")).join(sold, ["ts", "asset"], "left")


def with_momentum(panel: DataFrame, lookback: int = 3, power: float = 1.0) -> DataFrame:
    """Weights: the momentum over lookback periods to a power, as a z-score over the assets, clipped to 3, scaled to a gross of 1, and used one period later."""
    own = Window.partitionBy("run_id", "asset_idx").orderBy("t_idx")
    change = ratio(F.col("close"), F.lag("close", lookback).over(own)) - 1
    return standardized(panel.withColumn("_m", F.signum(change) * F.pow(F.abs(change), F.lit(power))), "_m").select(*panel.columns)


def standardized(rows: DataFrame, signal: str) -> DataFrame:
    """Rows with the weight that follows from a signal: its z-score over the period's assets, clipped to 3, scaled to a gross of 1, one period later."""
    own, across = Window.partitionBy("run_id", "asset_idx").orderBy("t_idx"), Window.partitionBy("run_id", "t_idx")
    z = rows.withColumn("_z", ratio(F.col(signal) - F.avg(signal).over(across), F.stddev_samp(signal).over(across)))
    clipped = z.withColumn("_z", F.when(F.col("_z").isNotNull(), F.greatest(F.least("_z", F.lit(3.0)), F.lit(-3.0))))
    scaled = clipped.withColumn("_w", ratio(F.col("_z"), F.sum(F.abs("_z")).over(across)))
    return scaled.withColumn("weight", F.lag("_w").over(own))


def market(spark: SparkSession, sf_dir: str, lookback: int = 3, power: float = 1.0) -> DataFrame:
    """The panel: orders execute at the close of the month before, weights follow momentum."""
    panel = monthly_cells(spark, sf_dir).withColumns({"run_id": F.lit("run"), "weight": F.lit(None).cast("double"), "close": finite(F.col("close")), "funding": finite(F.col("funding"))})
    own = Window.partitionBy("run_id", "asset_idx").orderBy("t_idx")
    priced = panel.withColumn("exec", F.when(F.col("t_idx") == 0, F.col("close")).otherwise(F.lag("close").over(own)))
    return with_momentum(priced, lookback, power).select(*PANEL)

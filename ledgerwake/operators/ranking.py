"""Ranks within groups that are too large for one task.

All rows are dealt by ranges of (group, value), so that a large group spreads over as many tasks as it has parts. A row's place
is its place in its part and the number of the group's rows in the parts before. Only values at the edges of parts can lie in
several parts: what these have together is a row for each such value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written

#: Rows of a group that a window ranks in one task; rows of a table of parts that is broadcast.
WIDE, MOST_BROADCAST = 1_000_000, 500_000


def is_wide(panel: DataFrame) -> bool:
    """Whether a period can have more assets than one task should sort."""
    last = panel.agg(F.max("asset_idx")).first()[0]
    return last is not None and last >= WIDE


def _side(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def ranks(rows: DataFrame, keys: list[str], value: str, tie: str, rank: str, place: str | None = None, size: str | None = None, parts: int | None = None) -> DataFrame:
    """Rows with their rank by a value that is never null: from 1, ties share the mean of their ranks. place: the number of rows before, ties in the order of another column; size: rows of the group. parts: in how many ranges rows are dealt."""
    order = [*keys, value, tie]
    dealt = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    own = written(dealt.withColumn("_part", F.spark_partition_id()), "ranges")  # what a part holds must not change when it is read again
    part = Window.partitionBy(*keys, "_part")
    local = own.withColumns({
        "_place": F.row_number().over(part.orderBy(value, tie)) - 1, "_less": F.rank().over(part.orderBy(value)) - 1,
        "_alike": F.count(F.lit(1)).over(Window.partitionBy(*keys, "_part", value)),
    })
    sums = local.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_in"), F.min(value).alias("_lo"), F.min_by("_alike", value).alias("_n_lo"), F.max(value).alias("_hi"), F.max_by("_alike", value).alias("_n_hi"),
    )
    across = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_in").over(across.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = written(sums.withColumns({"_before": before, "_size": F.sum("_in").over(across)}), "parts")
    low = sums.select(*keys, F.col("_lo").alias(value), F.col("_before").alias("_from"), F.col("_n_lo").alias("_n"))
    high = sums.filter("_lo <> _hi").select(*keys, F.col("_hi").alias(value), (F.col("_before") + F.col("_in") - F.col("_n_hi")).alias("_from"), F.col("_n_hi").alias("_n"))
    shared = written(low.unionByName(high).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_parts"), F.min("_from").alias("_from"), F.sum("_n").alias("_n")).filter("_parts > 1").drop("_parts"), "shared")
    out = local.join(_side(sums.select(*keys, "_part", "_before", "_size")), [*keys, "_part"]).join(_side(shared), [*keys, value], "left")
    own_rank = F.coalesce("_from", F.col("_before") + F.col("_less")) + (F.coalesce("_n", "_alike") + 1) / 2
    told = {rank: own_rank, **({place: F.col("_before") + F.col("_place")} if place else {}), **({size: F.col("_size")} if size else {})}
    return out.withColumns(told).select(*rows.columns, *told)

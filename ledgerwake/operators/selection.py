"""Exact quantiles of groups of any size, without sorting a group or holding its values in one place.

A group's range of values is cut in bins; rows are counted by bin, each task for itself first, and only the bin that holds the
wanted rank goes on, with its own least and greatest value as the new range. So what is kept for a group is a number of
counts, however many rows it has. What is left once a range holds few rows is ranked by a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written

#: Bins of a range; rows of a range that are ranked by a window; groups up to which ranges are broadcast.
BINS, FEW, MOST_BROADCAST = 4096, 10_000, 100_000


_STATE = ["_w", "_frac", "_rank", "_lo", "_hi", "_n", "_below", "_below_sum"]


def _within(rows: DataFrame, ranges: DataFrame, keys: list[str], n_ranges: int) -> DataFrame:
    """Each row with the range of its group that it lies in. Ranges of a group are equal or lie apart; there are n_ranges at most."""
    spans = ranges.select(*keys, "_lo", "_hi").distinct()
    side = F.broadcast(spans) if n_ranges <= MOST_BROADCAST else spans
    return rows.join(side, keys).filter("_x >= _lo and _x <= _hi")


def _narrowed(rows: DataFrame, ranges: DataFrame, keys: list[str], bins: int, n_ranges: int = 0) -> DataFrame:
    """Each range as the part of it, one bin, that holds its rank."""
    # halves, so that the width of no range is infinite; the bin never falls as the value rises
    share = (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    span = [*keys, "_lo", "_hi"]
    binned = _within(rows, ranges, keys, n_ranges).withColumn("_bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
    counted = binned.groupBy(*span, "_bin").agg(F.count(F.lit(1)).alias("_in"), F.sum("_x").alias("_in_sum"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    before = Window.partitionBy(*span).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumns({"_under": F.coalesce(F.sum("_in").over(before), F.lit(0)), "_under_sum": F.coalesce(F.sum("_in_sum").over(before), F.lit(0.0))})
    held = ranges.join(counted, span).filter("_rank >= _under and _rank < _under + _in")
    return held.select(*keys, "_w", "_frac", (F.col("_rank") - F.col("_under")).alias("_rank"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.col("_in").alias("_n"), (F.col("_below") + F.col("_under")).alias("_below"), (F.col("_below_sum") + F.col("_under_sum")).alias("_below_sum"))


def quantiles(rows: DataFrame, keys: list[str], value: str, at: list[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, at, quantile, tail_count, tail_sum) for each group of rows, a written table, and each of at, numbered from 0: the quantile, interpolated between the two ranks next to it, and the number and sum of values up to it. Missing values don't count; a group without any other has no row."""
    own = rows.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x is not null and not isnan(_x)")
    place = (F.col("_n") - 1) * F.col("_p")
    whole = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    asked = whole.select("*", F.posexplode(F.array(*(F.lit(float(p)) for p in at))).alias("_k", "_p"))
    sides = F.array(F.struct((2 * F.col("_k")).alias("_w"), F.floor(place).alias("_rank")), F.struct((2 * F.col("_k") + 1).alias("_w"), F.ceil(place).alias("_rank")))
    ranges = asked.select("*", (place - F.floor(place)).alias("_frac"), F.explode(sides).alias("_s"), F.lit(0).cast("long").alias("_below"), F.lit(0.0).alias("_below_sum")).select("*", "_s._w", "_s._rank").select(*keys, *_STATE)
    wide = (F.col("_n") > few) & (F.col("_lo") < F.col("_hi"))
    while True:
        ranges = written(ranges, "ranges")
        n_ranges, open_ = ranges.agg(F.count(F.lit(1)), F.count_if(wide)).first()
        if not open_:
            break
        ranges = _narrowed(own, ranges.filter(wide), keys, bins, n_ranges).unionByName(ranges.filter(~wide))
    # a range of one value is told by its bounds; of the others, each of few rows, the row of the rank is looked up
    told = ranges.filter("_lo = _hi").select(*keys, "_w", "_frac", F.col("_lo").alias("_v"), (F.col("_below") + F.col("_n")).alias("_count"), (F.col("_below_sum") + F.col("_n") * F.col("_lo")).alias("_sum"))
    w = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_x")
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    ordered = _within(own, ranges.filter("_lo < _hi"), keys, n_ranges).withColumns({"_rank": (F.row_number().over(w) - 1).cast("long"), "_in": F.count(F.lit(1)).over(upto), "_in_sum": F.sum("_x").over(upto)})
    looked = ranges.join(ordered, [*keys, "_lo", "_hi", "_rank"]).select(*keys, "_w", "_frac", F.col("_x").alias("_v"), (F.col("_below") + F.col("_in")).alias("_count"), (F.col("_below_sum") + F.col("_in_sum")).alias("_sum"))
    of = lambda side, c: F.max(F.when(F.col("_w") % 2 == side, F.col(c))).alias(f"{c}{side}")
    both = told.unionByName(looked).groupBy(*keys, F.floor(F.col("_w") / 2).cast("int").alias("at")).agg(F.max("_frac").alias("_frac"), *(of(side, c) for side in (0, 1) for c in ("_v", "_count", "_sum")))
    between = F.when(F.col("_v0") == F.col("_v1"), F.col("_v0")).otherwise((1 - F.col("_frac")) * F.col("_v0") + F.col("_frac") * F.col("_v1"))
    tail = lambda c: F.when(F.col("quantile") >= F.col("_v1"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    return both.withColumn("quantile", between).select(*keys, "at", "quantile", tail("_count").alias("tail_count"), tail("_sum").alias("tail_sum"))


def quantile(rows: DataFrame, keys: list[str], value: str, at: float, bins: int = BINS, few: int = FEW) -> DataFrame:
    """quantiles() for one."""
    return quantiles(rows, keys, value, [at], bins, few).drop("at")

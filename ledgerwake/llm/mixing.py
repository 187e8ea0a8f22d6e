"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

A source's mean repetition rate is what it takes to bring its characters to its share of the target. Each document draws its
number of copies by inverting the Poisson distribution of that mean at a number hashed from its id and a seed, so that a
rerun, or a lost executor, draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare, written

#: Weight of every source for which none is given.
EVEN = 1.0


def hashed_unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5; a null key counts as the empty text."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def poisson_count(rate: Column, draw: Column) -> Column:
    """The Poisson count of mean rate at a draw from [0, 1): how many of P(count <= 0), P(count <= 1), ... it reaches, as far as a double can tell them from 1. The terms are added up with three numbers as state, in as many steps as there are copies at most, and about 12 deviations more."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    reached = lambda total: F.when(total <= draw, 1).otherwise(0)
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), reached(F.exp(-rate)).alias("n"))

    def step(acc, k):
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), (acc["n"] + reached(total)).alias("n"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["n"])).otherwise(0)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, n_docs, chars, weight, rate) for each source, a null source among them. weights need not add up to 1; a source without one has EVEN. A source without characters has rate 0. epochs: characters aimed at, as a multiple of the input's."""
    amounts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.char_length(text), F.lit(0)).cast("long")).alias("chars"))
    weight = F.lit(EVEN)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
    amounts = amounts.select("*", F.when(F.col("chars") > 0, weight).otherwise(0.0).alias("weight"))
    totals = amounts.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.when((F.col("chars") > 0) & (F.col("weight") > 0), F.col("weight") / F.col("all_weight") * (F.col("all_chars") * epochs) / F.col("chars")).otherwise(0.0)
    return amounts.join(totals).select("source", "n_docs", "chars", "weight", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: int = 0, id_col: str = "doc_id", source: str = "source", text: str = "text", copy_col: str | None = None) -> DataFrame:
    """Each row as many times as it drew, shuffled globally by a hash; the columns of docs, and the copy's number from 1 as copy_col.

    Rows of the same id draw the same count; a null id draws like the empty text. A null or empty text has no characters: it
    counts for nothing, and is repeated as its source's other documents are; a source of such texts alone goes. A very long
    text counts whole. An empty table stays empty; extra columns may have any name. The rates are written first: Spark broadcasts a table of that file size only
    below its threshold, and else joins by shuffling, where a hot source is split by adaptive execution. The shuffle's key has
    the number of the input's partition in it, so that a row that is repeated all over the input doesn't meet its likes in one task.
    """
    name = {k: spare(f"_mix_{k}", docs.columns) for k in ("source", "rate", "draw", "count", "copy", "key")}
    own = rates(docs, weights, epochs, source, text)
    table = written(own.select(F.col("source").alias(name["source"]), F.col("rate").alias(name["rate"])), "rates")
    joined = docs.join(table, F.col(source).eqNullSafe(F.col(name["source"]))).withColumn(name["draw"], hashed_unit(F.col(id_col), seed))
    counted = joined.withColumn(name["count"], poisson_count(F.col(name["rate"]), F.col(name["draw"])))
    copies = counted.filter(F.col(name["count"]) > 0).withColumn(name["copy"], F.explode(F.sequence(F.lit(1), F.col(name["count"]))))
    keyed = copies.withColumn(name["key"], F.xxhash64(F.col(id_col), F.col(text), name["copy"], F.lit(seed), F.spark_partition_id()))
    shuffled = keyed.repartition(name["key"]).sortWithinPartitions(name["key"])
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return shuffled.select(*kept, *([F.col(name["copy"]).alias(copy_col)] if copy_col else []))

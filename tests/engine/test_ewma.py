import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerwake import queries as engine
from ledgerwake.operators import smoothing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows,block", [(7, 1 << 16), (7, 16), (1000, 50), (1, 3)])
def test_ewma_is_the_recursion_of_pandas(spark, rows, block):
    """Batches and blocks of several lengths; an asset that is known late, one that is unknown for several blocks, one that is never known."""
    draw = np.random.default_rng(0)
    wide = pd.DataFrame(draw.normal(size=(300, 5)))
    wide = wide.mask(draw.random(wide.shape) < 0.2)
    wide.loc[:120, 1], wide.loc[60:170, 2], wide.loc[:, 3], wide.loc[5:, 4] = np.nan, np.nan, np.nan, np.nan
    cells = [("r", t, a, None if np.isnan(wide.loc[t, a]) else float(wide.loc[t, a])) for t in wide.index for a in wide] + [("s", t, 0, float(t)) for t in range(40)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    got = smoothing.ewma(spark.createDataFrame(cells, "run_id string, t_idx int, asset_idx int, x double").repartition(3), "x", "mean", 0.8, 3, block).toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = wide.ewm(span=9, adjust=False, min_periods=3).mean()
    own = got[got["run_id"] == "r"].pivot(index="t_idx", columns="asset_idx", values="mean")
    assert len(got) == len(cells) and np.allclose(own, want, equal_nan=True)
    assert np.allclose(got[got["run_id"] == "s"].sort_values("t_idx")["mean"], pd.Series(range(40)).ewm(span=9, adjust=False, min_periods=3).mean(), equal_nan=True)


def test_one_long_asset_is_spread_over_tasks(spark):
    n = 100_000
    panel = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").cast("int").alias("t_idx"), F.lit(0).alias("asset_idx"), F.when(F.col("id") % 3 > 0, F.sin("id")).alias("x"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # this table is small enough for one task
    spark.conf.set(key, "false")
    got = smoothing.ewma(panel, "x", "mean", 0.99, block=5_000).withColumn("task", F.spark_partition_id()).toPandas().sort_values("t_idx")
    spark.conf.unset(key)
    x = pd.Series(np.where(np.arange(n) % 3 > 0, np.sin(np.arange(n)), np.nan))
    assert np.allclose(got["mean"], x.ewm(alpha=0.01, adjust=False).mean(), equal_nan=True) and got["task"].nunique() > 1


def test_query_equals_sql(spark):
    db = duckdb.connect()
    for t in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = engine.QUERIES["ewma_whole"](spark, SF)
    got = sorted(map(str, map(tuple, df.collect())))
    assert got and got == sorted(map(str, db.execute(engine.ORACLE_SQL["ewma_whole"]).fetchall()))

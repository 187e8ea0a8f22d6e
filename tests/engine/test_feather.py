import pandas as pd
import pyarrow as pa
import pyarrow.feather
import pytest

import ledgerwake as lw
from ledgerwake.sources.feather import read_feather, write_feather
from ledgerwake.sources.frames import market_panel


def test_a_file_of_pandas_by_its_batches(spark, tmp_path):
    frame = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=1000, freq="h"), "BTC": range(1000), "ETH": [None, 1.5] * 500, "name": ["x", None] * 500})
    pyarrow.feather.write_feather(pa.table(frame), str(tmp_path / "close.feather"), chunksize=100)
    got = read_feather(spark, str(tmp_path / "close.feather"))
    assert got.rdd.getNumPartitions() == 10 and dict(got.dtypes)["ts"] == "timestamp_ntz" and got.count() == 1000
    part = read_feather(spark, f"file://{tmp_path}", ["ETH", "ts"])
    assert part.columns == ["ETH", "ts"] and part.filter("ETH is null").count() == 500
    with pytest.raises(Exception, match="no column"):
        read_feather(spark, str(tmp_path), ["DOGE"])
    with pytest.raises(Exception, match="no Feather file"):
        read_feather(spark, str(tmp_path / "none"))


def test_a_wide_file_is_a_market(spark, tmp_path):
    frame = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=5), "B": [1.0, 2, 3, 4, 5], "A": [5.0, 4, 3, 2, 1]})
    pyarrow.feather.write_feather(frame, str(tmp_path / "wide.feather"))
    wide = read_feather(spark, str(tmp_path / "wide.feather"))
    own = frame.set_index("ts")
    a, b = (sorted(map(str, market_panel(spark, x, lw.MarketData(x, x)).collect())) for x in (wide, own))
    assert a == b


def test_written_and_read(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "cast(id as string) as s").repartition(3)
    path = write_feather(df, str(tmp_path / "out"))
    assert sorted(read_feather(spark, path).collect()) == sorted(df.collect())
    assert read_feather(spark, write_feather(df.limit(0))).count() == 0

import pytest
from pyspark.sql import functions as F

from ledgerwake.config import SimConfig
from ledgerwake.operators import replay
from ledgerwake.sources import market
from ledgerwake.streaming.replay import replay_stream, whole_periods


def test_stream_equals_batch(spark, tmp_path):
    panel = market.market(spark, "/root/testdata/sf0.001").filter("t_idx < 12")
    config = SimConfig(fee_rate=0.001)
    periods = whole_periods(panel).persist()
    for k, part in enumerate(("t_idx < 5", "t_idx >= 5")):
        periods.filter(part).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(periods.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    query = replay_stream(stream, config).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.t_idx: r.equity for r in spark.table("replayed").collect()}
    expected = {r.t_idx: r.equity for r in replay.replay(panel, config).select("t_idx", F.col("equity")).collect()}
    assert got == pytest.approx(expected, rel=1e-12)

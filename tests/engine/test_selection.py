import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwake.operators import selection


def groups():
    draw = np.random.default_rng(4)
    return {
        "normal": draw.normal(size=5000), "ties": draw.integers(0, 4, 3000).astype(float), "one": np.array([2.5]), "two": np.array([1.0, -3.0]), "equal": np.full(400, 7.0),
        "outlier": np.r_[draw.normal(size=700) * 1e-9, 1e300, -1e308, 1e308], "mostly one": np.r_[np.full(900, 1.0), draw.normal(size=50)],
    }


@pytest.mark.parametrize("at,bins,few", [(0.5, 16, 3), (0.05, 4096, 10), (0.05, 4096, 10_000)])
def test_equals_numpy(spark, at, bins, few):
    own = groups()
    rows = spark.createDataFrame([(k, float(x)) for k, v in own.items() for x in v] + [("one", None), ("one", float("nan")), ("none", None)], "g string, v double").repartition(7)
    got = {r.g: r for r in selection.quantile(rows, ["g"], "v", at, bins, few).collect()}
    assert set(got) == set(own)
    for k, v in own.items():
        want = np.percentile(v, 100 * at)
        assert got[k].quantile == pytest.approx(want, rel=1e-12, abs=1e-300), k
        tail = v[v <= got[k].quantile]
        assert got[k].tail_count == len(tail) and got[k].tail_sum == pytest.approx(tail.sum(), rel=1e-9, abs=1e-12), k


def test_one_large_group_is_counted_and_not_gathered(spark):
    """No aggregate keeps values: the plan of a pass has counts, sums, minima and maxima alone, and few rows reach the window."""
    rows = spark.range(200_000).select(F.lit("all").alias("g"), (F.xxhash64("id") / 2.0**63).alias("v"))
    got = selection.quantile(rows, ["g"], "v", 0.5, bins=512, few=100).first()
    values = np.sort(np.array(rows.select("v").toPandas()["v"]))
    assert got.quantile == np.percentile(values, 50)
    plan = selection._narrowed(rows.select("g", F.col("v").alias("_x")), spark.createDataFrame([("all", 0, 0.5, 7, -1.0, 1.0, 10, 0, 0.0)], "g string, _w int, _frac double, _rank long, _lo double, _hi double, _n long, _below long, _below_sum double"), ["g"], 512)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect" not in plan and "percentile" not in plan


def test_many_at_once(spark):
    values = np.random.default_rng(1).normal(size=3000)
    rows = spark.createDataFrame([("a", float(x)) for x in values] + [("b", float(k)) for k in range(11)], "g string, v double")
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for few in (20, 10_000):
        got = {(r.g, r.at): r.quantile for r in selection.quantiles(rows, ["g"], "v", at, 64, few).collect()}
        assert got == {**{("a", k): pytest.approx(np.percentile(values, 100 * p), abs=1e-15) for k, p in enumerate(at)}, **{("b", k): pytest.approx(10 * p) for k, p in enumerate(at)}}

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerwake.operators import ranking, signal


def table():
    draw = np.random.default_rng(2)
    parts = [pd.DataFrame({"g": g, "v": v, "asset_idx": draw.permutation(len(v))}) for g, v in (("one", np.array([1.0])), ("ties", draw.integers(0, 3, 400).astype(float)), ("equal", np.full(300, 2.0)), ("normal", draw.normal(size=500)), ("two", np.array([0.0, -0.0])))]
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_ranks_equal_those_of_pandas(spark, parts):
    """Groups that lie in many parts, and values that do."""
    own = table()
    got = ranking.ranks(spark.createDataFrame(own), ["g"], "v", "asset_idx", "rank", "place", "size", parts).toPandas().sort_values(["g", "asset_idx"], ignore_index=True)
    want = own.sort_values(["g", "asset_idx"], ignore_index=True)
    assert (got["rank"] == want.groupby("g")["v"].rank()).all() and (got["size"] == want.groupby("g")["v"].transform("size")).all()
    ordered = want.sort_values(["g", "v", "asset_idx"])
    assert (got["place"] == ordered.groupby("g").cumcount().reindex(want.index)).all()


def test_wide_sections_equal_plain_ones(spark):
    draw = np.random.default_rng(6)
    cells = [("r", t, datetime(2024, 1, 1 + t), str(a), a, float(draw.integers(-3, 4)) / 8, float(100 + draw.integers(0, 9))) for t in range(9) for a in range(60)]
    panel = spark.createDataFrame(cells, "run_id string, t_idx int, ts timestamp_ntz, asset string, asset_idx int, weight double, close double")
    for f in (signal.cross_sections, signal.decile_curves, lambda p, wide: signal.horizon_decay(p, [1, 3], wide)):
        plain, wide = ([[round(x, 9) if isinstance(x, float) else x for x in r] for r in sorted(f(panel, wide=w).collect(), key=lambda r: r[1])] for w in (False, True))
        assert plain == wide
    assert not ranking.is_wide(panel) and not ranking.is_wide(panel.limit(0)) and panel.agg(F.max("asset_idx")).first()[0] == 59

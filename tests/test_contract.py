import duckdb
import pytest

import __spark_entry__ as contract
from ledgerwake import queries as engine

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert contract.entry(spark).columns == ["t_idx", "ts", "equity", "ret", "cash"]


def test_every_engine_query_has_sql():
    assert set(engine.QUERIES) == set(engine.ORACLE_SQL) <= set(contract.queries())


@pytest.mark.parametrize("name", ["panel_dense", "simulate_equity", "metrics_risk", "decile_curves", "grid_summary", "fold_stats", "signal_series", "synthetic_market", "warmup_trim"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = engine.QUERIES[name](spark, SF)
    sql = db.execute(engine.ORACLE_SQL[name])
    at = [[d[0] for d in sql.description].index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(row[k] for k in at)) for row in sql.fetchall())

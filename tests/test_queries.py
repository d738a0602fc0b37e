"""Registered queries vs their DuckDB oracles on the small fixture (sf0.001),
plus the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from fleetscope.sources.driver import TABLES

FAST = ["agg02_rollup_5min", "win01_latest_per_gpu", "agg06_fleet_summary", "agg09_rack_summary",
        "agg12_baseline_stats", "ana01_health_scores", "ana03_features", "ana04_failure_predictions",
        "ana05_economic_decisions", "win02_gap_counts", "agg19_temp_trend_slope", "val05_validation_errors",
        "src01_exposition_parse", "ana08_market_prices", "ana07_temperature_forecast"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", FAST)
def test_query_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF_SMALL)
    cols = df.columns
    got = sorted(tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    assert sorted(ocols) == sorted(cols)
    idx = [ocols.index(c) for c in sorted(cols)]
    exp = sorted(tuple(_norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == exp


def test_entry_contract(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].total_gpus > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

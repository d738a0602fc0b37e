"""The table-chained analytics cycle equals the end-to-end queries and is idempotent."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from fleetscope.plans.cycle import run_cycle
from fleetscope.sources.driver import load_fleet

PARAMS = {"lookback_days": 30, "active": "1 day", "gap_seconds": 86400, "sample_seconds": 36000,
          "feature_lookback": "30 days", "baseline": "30 days", "recent": "1 day", "util_window": "30 days",
          "gap_bucket": "1 day"}


def test_cycle_matches_queries_and_replays(spark, tmp_path_str):
    t = load_fleet(spark, SF_SMALL)
    as_of = t["metrics"].agg(F.max("time")).first()[0]
    paths = run_cycle(spark, t["metrics"], t["assets"], tmp_path_str, as_of, PARAMS)
    cols = ["gpu_uuid", "decision", "npv_keep", "npv_sell", "npv_repurpose", "salvage_value", "confidence"]
    stored = spark.read.parquet(paths["gpu_economic_decisions"]).select(*cols)
    direct = entry.queries()["ana05_economic_decisions"](spark, SF_SMALL).select(*cols)
    assert stored.count() == direct.count() > 0
    assert stored.exceptAll(direct).count() == 0
    from fleetscope.operators.tables import read_or_none

    def counts():
        return {k: (lambda d: 0 if d is None else d.count())(read_or_none(spark, p)) for k, p in paths.items()}
    before = counts()
    run_cycle(spark, t["metrics"], t["assets"], tmp_path_str, as_of, PARAMS)  # replay the same cycle
    assert counts() == before

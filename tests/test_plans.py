"""Plan inspection: windows over raw telemetry are never partitioned by the device alone
(a hot device would land in one task), time windows prune the partitions of a
date-partitioned table, and no join is hinted."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fleetscope.functions.timewin import as_of_col
from fleetscope.operators import anomaly, design, economics, features, fleet, forecast, health, latest, ordered, predict, tables
from fleetscope.sources.driver import load_fleet


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


WINDOW = re.compile(r"\bWindow \[.*\], \[([^\]]*)\], \[([^\]]*)\]\s*$")


def device_only_windows_are_bounded(plan):
    """Every Window partitioned by the device alone must sit on a partial limit (at most
    n rows per device and task reach it) or be ordered by the bucket column: its rows are
    aggregates, or a fixed number of edge rows, per (device, bucket)."""
    seen = 0
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        m = WINDOW.search(line)
        if not m:
            continue
        seen += 1
        part = [c.strip() for c in m.group(1).split(",") if c.strip()]
        if len(part) == 1 and part[0].startswith("gpu_uuid"):
            child = lines[i + 1] if i + 1 < len(lines) else ""
            assert "WindowGroupLimit" in child or "_b#" in m.group(2), line
    return seen


def test_raw_windows_are_bucketed(spark):
    t = load_fleet(spark, SF_SMALL)
    m = t["metrics"]
    a = as_of_col(m)
    for df in (latest.latest_n_per_key(m, 24),
               latest.latest_n_per_key(m, 50_000),
               health.health_scores(m, a, 30, "1 day", 86400, 36000),
               features.gpu_features(m, t["assets"], a, "30 days")):
        assert device_only_windows_are_bounded(_plan(df)) > 0
    for df in (ordered.gap_counts(m, "gpu_uuid", "time", 300), ordered.index_slope(m, "gpu_temp"), design.moving_average(m, "gpu_temp", 3),
               design.savgol5(m, "gpu_temp"), design.largest_gaps(m, 10), design.interpolate_grid(m, "gpu_temp")):
        assert "Window" not in _plan(df) and "rangepartitioning" in _plan(df)


def test_rolling_statistics_need_one_shuffle(spark):
    plan = _plan(design.rolling_stats(load_fleet(spark, SF_SMALL)["metrics"], "gpu_temp", 86400))
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1 and "Window" not in plan


@pytest.fixture(scope="module")
def dated(spark, tmp_path_factory):
    """Telemetry and stored analytics as date-partitioned tables, 30 days."""
    root = str(tmp_path_factory.mktemp("dated"))
    t = load_fleet(spark, SF_SMALL)
    tables.append(t["metrics"], root + "/metrics")
    m = spark.read.parquet(root + "/metrics")
    a = F.lit(dt.datetime(2024, 1, 20)).cast("timestamp")
    tables.append(features.gpu_features(m, t["assets"], a, "7 days"), root + "/features")
    scores = health.health_scores(m, a, 7, "1 day", 86400, 36000, "1 day").drop("degradation_factors")
    tables.append(scores, root + "/scores")
    return m, t["assets"], a, spark.read.parquet(root + "/features"), spark.read.parquet(root + "/scores")


def _opens_every_partition(df):
    return re.findall(r"FileScan parquet \[[^\]]*gpu_uuid.*?PartitionFilters: \[\]", _plan(df), re.S)


def test_time_windows_prune_partitions(dated):
    m, assets, a, stored_features, stored_scores = dated
    for name, df in {
        "ANA1": health.health_scores(m, a, 7, "1 hour"),
        "JON14": health.score_history(m, a, 2, 7, 7, "1 day"),
        "ANA2": anomaly.detect_anomalies(m, a),
        "ANA3": features.gpu_features(m, assets, a),
        "ANA4": predict.predict_failures(stored_features, a),
        "ANA5": economics.economic_decisions(stored_scores, None, assets, m, a, "7 days"),
        "ANA7": forecast.linear_forecast(m, "gpu_temp", a, 5, 60.0, "1 day"),
        "ANA10": design.risk_score(m, a),
        "AGG10": fleet.gpu_stats(m, a),
        "SNK10": tables.refresh_frame(m, "5min", a, "2 days", "1 minute"),
        "WIN1": fleet.latest_metrics(m, as_of=a, lookback="1 day"),
    }.items():
        plan = _plan(df)
        assert "PartitionFilters: [isnotnull(date" in plan or re.search(r"PartitionFilters: \[[^\]]*date", plan), name
        if name not in ("ANA7",):
            assert not re.findall(r"Location: InMemoryFileIndex[^\n]*metrics[^\n]*PartitionFilters: \[\]", plan), name


def test_pruning_changes_no_result(dated, spark):
    m, assets, a, _, _ = dated
    plain = m.drop("date")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(health.health_scores(m, a, 7, "1 day", 86400, 36000)) == key(health.health_scores(plain, a, 7, "1 day", 86400, 36000))
    cols = ["gpu_uuid", "sample_count", "min_temp", "max_temp", "throttle_events"]
    assert key(fleet.gpu_stats(m, a, "3 days").select(*cols)) == key(fleet.gpu_stats(plain, a, "3 days").select(*cols))


def test_no_broadcast_is_hinted(spark):
    t = load_fleet(spark, SF_SMALL)
    df = features.gpu_features(t["metrics"], t["assets"], as_of_col(t["metrics"]), "30 days")
    assert "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString()

"""The periodic analytics cycle as a chain of fleet-wide jobs through stored tables.

The reference runs five polling services, one GPU at a time. Here each stage is
one Spark job over all devices, and stages hand over through date-partitioned
parquet tables (the reference's database tables), so a composite result never
recomputes its inputs and every stage is restartable on its own:

    metrics -> features -> predictions ┐
    metrics -> health ─────────────────┴-> decisions
    metrics -> anomalies

Writes are idempotent on their keys (insert-ignore), so re-running a cycle for
the same ``as_of`` after a failure changes nothing it already wrote.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.operators import anomaly, economics, features, health, predict, tables

TABLES = ("gpu_features", "gpu_failure_predictions", "gpu_health_scores", "anomalies", "gpu_economic_decisions")


#: Columns of the stored feature table, in its order.
FEATURE_TABLE = ["time", "gpu_uuid", *features.STORED_FEATURES, "feature_version", "computed_at"]


def run_cycle(spark: SparkSession, metrics: DataFrame, assets: DataFrame, root: str,
              as_of: _dt.datetime, params: dict | None = None) -> dict[str, str]:
    """Run one cycle at ``as_of``; returns the table paths written."""
    p = {"lookback_days": 7, "active": "1 hour", "gap_seconds": 300, "sample_seconds": 10,
         "feature_lookback": "7 days", "baseline": "24 hours", "recent": "5 minutes",
         "util_window": "30 days", "gap_bucket": "1 hour", "population": "24 hours"}
    p.update(params or {})
    a = F.lit(as_of).cast("timestamp")
    paths = {t: f"{root.rstrip('/')}/{t}" for t in TABLES}

    f = features.gpu_features(metrics, assets, a, p["feature_lookback"], trend_bucket=p["gap_bucket"])
    f = features.project_to_table(f, FEATURE_TABLE)
    tables.append_ignore(f, paths["gpu_features"], ["time", "gpu_uuid"])
    stored_f = spark.read.parquet(paths["gpu_features"])

    pr = predict.predict_failures(stored_f, a, active=p["population"])
    pr = pr.withColumn("feature_importance", F.to_json("feature_importance"))
    tables.append_ignore(pr, paths["gpu_failure_predictions"], ["time", "gpu_uuid"])

    h = health.health_scores(metrics, a, p["lookback_days"], p["active"], p["gap_seconds"], p["sample_seconds"],
                             gap_bucket=p["gap_bucket"])
    tables.append_ignore(h.withColumn("degradation_factors", F.to_json("degradation_factors")),
                         paths["gpu_health_scores"], ["time", "gpu_uuid"])

    an = anomaly.detect_anomalies(metrics, a, p["baseline"], p["recent"])
    tables.append_ignore(an, paths["anomalies"], ["time", "gpu_uuid", "anomaly_type"])

    scores = spark.read.parquet(paths["gpu_health_scores"])
    preds = spark.read.parquet(paths["gpu_failure_predictions"])
    d = economics.economic_decisions(scores, preds, assets, metrics, a, p["util_window"], p["population"])
    tables.append_ignore(d, paths["gpu_economic_decisions"], ["time", "gpu_uuid"])
    return paths

"""Z-score anomaly detection for the whole fleet (AGG12, ANA2, AGG16, PRJ16, FLT6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.columns import severity_level
from fleetscope.functions.timewin import as_of_col, since, window_rows
from fleetscope.operators.health import round_half_up

BASELINE_METRICS = {"temp": "gpu_temp", "power": "power_usage", "sm": "sm_active",
                    "mem_util": "memory_utilization"}


def baseline_stats(metrics: DataFrame, as_of: Column, window: str = "24 hours") -> DataFrame:
    """Per-device mean and sample std of four metrics over ``time >= as_of - window`` (AGG12)."""
    rows = window_rows(metrics, as_of, window, strict=False)
    aggs = []
    for short, c in BASELINE_METRICS.items():
        aggs += [F.avg(c).alias(f"{short}_mean"), F.stddev_samp(c).alias(f"{short}_std")]
    return rows.groupBy("gpu_uuid").agg(*aggs)


def _z(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, F.abs((value - mean) / std)).otherwise(F.lit(0.0))


def detect_anomalies(metrics: DataFrame, as_of=None, baseline: str = "24 hours", recent: str = "5 minutes",
                     z: float = 3.0) -> DataFrame:
    """Anomaly rows (time, gpu_uuid, anomaly_type, value, z_score, baseline_mean, severity, ...).

    The baseline includes the recent window, as the reference's does; devices
    whose temperature std is NULL (fewer than two samples) are skipped. Recent
    rows are joined to the one-row-per-device baseline (AQE broadcasts it when
    small) and each row emits up to three typed anomalies via ``explode``.
    """
    a = as_of_col(metrics, as_of)
    b = baseline_stats(metrics, a, baseline).where(F.col("temp_std").isNotNull())
    r = window_rows(metrics, a, recent, strict=False).select("time", "gpu_uuid", "gpu_temp", "power_usage", "sm_active")
    j = r.join(b, "gpu_uuid", "inner")
    tz = _z(F.col("gpu_temp"), F.col("temp_mean"), F.col("temp_std"))
    pz = _z(F.col("power_usage"), F.col("power_mean"), F.col("power_std"))
    sz = _z(F.col("sm_active"), F.col("sm_mean"), F.col("sm_std"))
    cand = F.array(
        F.struct(F.lit("temperature").alias("anomaly_type"), F.col("gpu_temp").alias("value"), tz.alias("z"),
                 F.col("temp_mean").alias("mean"),
                 F.when(tz > 4, "high").otherwise("medium").alias("severity")),
        F.struct(F.lit("power_usage").alias("anomaly_type"), F.col("power_usage").alias("value"), pz.alias("z"),
                 F.col("power_mean").alias("mean"),
                 F.when(pz > 4, "medium").otherwise("low").alias("severity")),
        F.struct(F.lit("utilization").alias("anomaly_type"), F.col("sm_active").alias("value"), sz.alias("z"),
                 F.col("sm_mean").alias("mean"), F.lit("low").alias("severity")),
    )
    hits = F.filter(cand, lambda s: s["z"] > F.lit(z))
    return (j.select("time", "gpu_uuid", F.explode(hits).alias("x"))
             .select("time", "gpu_uuid", F.col("x.anomaly_type").alias("anomaly_type"),
                     F.col("x.value").alias("value"), round_half_up(F.col("x.z"), 2).alias("z_score"),
                     round_half_up(F.col("x.mean"), 2).alias("baseline_mean"), F.col("x.severity").alias("severity"),
                     a.alias("detected_at"), F.lit(False).alias("acknowledged"),
                     F.lit(None).cast("timestamp").alias("acknowledged_at"),
                     F.lit(None).cast("string").alias("acknowledged_by")))


def anomaly_counts(anomalies: DataFrame, as_of: Column, window: str = "1 hour",
                   time_col: str = "detected_at") -> DataFrame:
    """Anomalies per device detected within ``window`` (AGG16)."""
    return (anomalies.where(since(time_col, as_of, window)).groupBy("gpu_uuid")
            .agg(F.count(F.lit(1)).alias("anomalies_detected")))


def severity_timeline(anomalies: DataFrame, as_of: Column, window: str = "6 hours") -> DataFrame:
    """(detected_at, severity level 1..4) per device (PRJ16)."""
    return (anomalies.where(since("detected_at", as_of, window))
            .select("gpu_uuid", "time", "anomaly_type", F.col("detected_at"),
                    severity_level("severity").alias("severity_level")))


def unacknowledged_high(anomalies: DataFrame, as_of: Column, window: str = "10 minutes", top: int = 10,
                        severity: str = "high") -> DataFrame:
    """Unacknowledged anomalies of a severity detected since ``as_of - window`` (the bound
    included), newest 10 (FLT6, ANA6, TOP4)."""
    return (anomalies.where(since("detected_at", as_of, window, strict=False)
                            & ~F.coalesce(F.col("acknowledged"), F.lit(False)) & (F.col("severity") == severity))
            .select("gpu_uuid", "anomaly_type", "value", "z_score", "severity", "time")
            .orderBy(F.col("time").desc(), F.col("gpu_uuid"), F.col("anomaly_type")).limit(top))

"""Time-bucket rollups (AGG1-AGG5, AGG27-AGG31, AGG38, WIN14).

Buckets are epoch-aligned tumbling windows, identical to ``time_bucket`` for
second/minute/hour widths. Every aggregate is algebraic (sum/count/min/max),
so Spark combines map-side before the shuffle on (bucket, device, host).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.quantile import exact_quantiles

# The stored rollup levels and whether they carry ``power_usage_min``.
LEVELS = {
    "1min": ("1 minute", False),
    "5min": ("5 minutes", True),
    "1hour": ("1 hour", True),
    "1day": ("1 day", True),
}


def bucket(time_col: str, every: str) -> Column:
    """Epoch-aligned bucket start of width ``every`` (``'10 seconds'``, ``'5 minutes'``)."""
    return F.window(F.col(time_col), every).start


def rollup(metrics: DataFrame, every: str = "5 minutes", power_min: bool = True,
           keys=("gpu_uuid", "hostname"), time_col: str = "time") -> DataFrame:
    """Per-device rollup row of the continuous aggregates (AGG1/AGG2/AGG3).

    The 1-hour level is computed from raw rows, never as an average of 1-minute
    averages, which would weight buckets instead of samples.
    """
    aggs = [
        F.avg("gpu_temp").alias("gpu_temp_avg"),
        F.max("gpu_temp").alias("gpu_temp_max"),
        F.min("gpu_temp").alias("gpu_temp_min"),
        F.avg("memory_temp").alias("memory_temp_avg"),
        F.max("memory_temp").alias("memory_temp_max"),
        F.avg("power_usage").alias("power_usage_avg"),
        F.max("power_usage").alias("power_usage_max"),
    ]
    if power_min:
        aggs.append(F.min("power_usage").alias("power_usage_min"))
    aggs += [
        F.avg("sm_active").alias("sm_active_avg"),
        F.max("sm_active").alias("sm_active_max"),
        F.avg("memory_utilization").alias("memory_util_avg"),
        F.max("memory_utilization").alias("memory_util_max"),
        F.sum(F.col("ecc_sbe_volatile").cast("long")).alias("ecc_sbe_count"),
        F.sum(F.col("ecc_dbe_volatile").cast("long")).alias("ecc_dbe_count"),
        F.count(F.lit(1)).alias("sample_count"),
    ]
    # group on the window struct itself (not its start) so a streaming input's
    # watermark applies to the bucket and append mode can close it
    out = metrics.groupBy(F.window(F.col(time_col), every).alias("_w"), *keys).agg(*aggs)
    return out.select(F.col("_w.start").alias("time"), *[c for c in out.columns if c != "_w"])


def rollup_level(metrics: DataFrame, level: str) -> DataFrame:
    every, power_min = LEVELS[level]
    return rollup(metrics, every, power_min)


def group_series(metrics: DataFrame, members: DataFrame, every: str = "10 seconds",
                 group_col: str = "datacenter", value_col: str = "power_usage",
                 how: str = "sum", out: str | None = None, time_col: str = "time") -> DataFrame:
    """Per-group time series (AGG4 total power, AGG5 mean utilisation).

    ``members`` maps device -> group (the datacenter mapping); the dashboard's
    ``gpu_uuid IN (SELECT ...)`` becomes a join to that small dimension, for every
    group at once.
    """
    agg = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[how]
    m = members.select("gpu_uuid", group_col)
    return (metrics.select("gpu_uuid", time_col, value_col)
                   .join(m, "gpu_uuid", "inner")
                   .groupBy(F.col(group_col), bucket(time_col, every).alias("time"))
                   .agg(agg(value_col).alias(out or f"{how}_{value_col}")))


def temperature_trend(metrics: DataFrame, every: str = "5 minutes", keys=("gpu_uuid",)) -> DataFrame:
    """Bucketed temperature mean/max/min/stddev (AGG27)."""
    return (metrics.groupBy(*keys, bucket("time", every).alias("time"))
                   .agg(F.avg("gpu_temp").alias("avg_temp"), F.max("gpu_temp").alias("max_temp"),
                        F.min("gpu_temp").alias("min_temp"), F.stddev_samp("gpu_temp").alias("stddev_temp"),
                        F.count(F.lit(1)).alias("sample_count")))


def ecc_per_bucket(metrics: DataFrame, every: str = "1 hour", min_delta: int = 0) -> DataFrame:
    """Counter delta per bucket = max - min, kept when > ``min_delta`` (AGG28, HAVING)."""
    return (metrics.groupBy("gpu_uuid", bucket("time", every).alias("time"))
                   .agg((F.max("ecc_sbe_aggregate") - F.min("ecc_sbe_aggregate")).alias("sbe_delta"),
                        (F.max("ecc_dbe_aggregate") - F.min("ecc_dbe_aggregate")).alias("dbe_delta"))
                   .where((F.col("sbe_delta") > min_delta) | (F.col("dbe_delta") > min_delta)))


def utilization_per_watt(metrics: DataFrame, every: str = "15 minutes") -> DataFrame:
    """avg(utilisation) / NULLIF(avg(power), 0) per bucket (AGG29, PRJ26)."""
    return (metrics.groupBy("gpu_uuid", bucket("time", every).alias("time"))
                   .agg(F.avg("sm_active").alias("avg_util"), F.avg("power_usage").alias("avg_power"))
                   .withColumn("util_per_watt", F.try_divide(F.col("avg_util"), F.nullif(F.col("avg_power"), F.lit(0.0)))))


def bucket_percentile(metrics: DataFrame, every: str, value_col: str, p: float) -> DataFrame:
    """Exact interpolated percentile per bucket of the whole fleet: (time, value).

    Found by histogram refinement (``operators/quantile.py``); each round is a job.
    """
    return exact_quantiles(metrics, bucket("time", every), F.col(value_col), {"value": p}).withColumnRenamed("b", "time")


def fleet_buckets(metrics: DataFrame, every: str = "5 minutes", exact: bool = True) -> DataFrame:
    """Fleet-wide bucket summary with p95 temperature and distinct devices (AGG30/AGG32).

    ``exact`` gives the ``percentile_cont`` value and exact distinct counts (batch);
    otherwise the mergeable sketches are used, as a stream must (relative error of the
    distinct count 5 %, rank error of the percentile 1 / 10,000).
    """
    b = bucket("time", every).alias("time")
    rest = [F.avg("gpu_temp").alias("avg_temp"), F.sum("power_usage").alias("total_power"), F.count(F.lit(1)).alias("event_count")]
    if not exact:
        return metrics.groupBy(b).agg(F.approx_count_distinct("gpu_uuid").alias("gpu_count"),
                                      F.percentile_approx("gpu_temp", 0.95).alias("p95_temp"), *rest)
    # devices are counted on (bucket, device) rows, so a busy bucket's set is spread out
    per_device = metrics.groupBy(b, "gpu_uuid").agg(F.sum("gpu_temp").alias("_t"), F.count("gpu_temp").alias("_tn"),
                                                    F.sum("power_usage").alias("_p"), F.count(F.lit(1)).alias("_e"))
    g = per_device.groupBy("time").agg(F.count("gpu_uuid").alias("gpu_count"), F.try_divide(F.sum("_t"), F.sum("_tn")).alias("avg_temp"),
                                       F.sum("_p").alias("total_power"), F.sum("_e").alias("event_count"))
    return (g.join(bucket_percentile(metrics, every, "gpu_temp", 0.95).withColumnRenamed("value", "p95_temp"), "time", "left")
             .select("time", "gpu_count", "p95_temp", "avg_temp", "total_power", "event_count"))


def rollup_15min(metrics: DataFrame) -> DataFrame:
    """Document-only 15-minute level with stddev and ECC delta (AGG31)."""
    return (metrics.groupBy(bucket("time", "15 minutes").alias("time"), "gpu_uuid")
                   .agg(F.avg("gpu_temp").alias("gpu_temp_avg"), F.stddev_samp("gpu_temp").alias("gpu_temp_stddev"),
                        F.max("gpu_temp").alias("gpu_temp_max"), F.avg("power_usage").alias("power_usage_avg"),
                        (F.max("ecc_sbe_aggregate") - F.min("ecc_sbe_aggregate")).alias("ecc_sbe_delta"),
                        F.count(F.lit(1)).alias("sample_count")))

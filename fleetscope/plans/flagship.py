"""The flagship query: raw events -> telemetry -> 5-minute rollup -> latest
bucket per device -> fleet summary (SURVEY §7.3 step 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.operators import rollups
from fleetscope.operators.latest import latest_per_key
from fleetscope.sources.driver import load_fleet


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load_fleet(spark, sf_dir)["metrics"]
    r = rollups.rollup_level(m, "5min")
    last = latest_per_key(r, "gpu_uuid", "time", ["gpu_temp_avg", "gpu_temp_max", "power_usage_avg",
                                                  "ecc_dbe_count", "sample_count"])
    return last.agg(
        F.count_distinct("gpu_uuid").alias("total_gpus"),
        F.round(F.avg("gpu_temp_avg"), 6).alias("avg_temp"),
        F.round(F.max("gpu_temp_max"), 6).alias("max_temp"),
        F.round(F.avg("power_usage_avg"), 6).alias("avg_power"),
        F.sum(F.when(F.col("ecc_dbe_count") > 0, 1).otherwise(0)).alias("dbe_error_count"),
        F.sum("sample_count").alias("samples_in_latest_buckets"),
    )

"""Feature store rows for every device at once (ANA3: AGG19-AGG25, PRJ18-PRJ20).

Two passes over the window's rows: one into partials per (device, bucket), from
which means, sample stds, counts, counter ranges and the temperature trend are
combined, and one join of the per-device mean/std back to the rows for the
two-sided outlier counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.columns import (BIT_HW_POWER_BRAKE, BIT_HW_THERMAL, BIT_SW_POWER_CAP, bit_set,
                                          days_floor)
from fleetscope.functions.timewin import as_of_col, window_rows
from fleetscope.operators.partials import bucket_partials, combine, combined_moments, mean, moment_aggs, std

FEATURE_VERSION = "1.0"
SAMPLE_SECONDS = 10

# The 27 columns of the stored feature table, in table order.
STORED_FEATURES = [
    "gpu_temp_mean", "gpu_temp_std", "gpu_temp_min", "gpu_temp_max", "gpu_temp_trend",
    "power_usage_mean", "power_usage_std", "power_usage_cv", "power_efficiency",
    "sm_active_mean", "sm_active_std", "sm_occupancy_mean", "memory_util_mean", "memory_util_std",
    "thermal_throttle_count", "power_brake_count", "sw_power_cap_count", "ecc_sbe_event_count",
    "ecc_dbe_event_count", "temp_spike_count", "power_anomaly_count", "throttle_duration_hours",
    "gpu_age_days", "warranty_remaining_days", "total_operating_hours", "model_a100", "model_h100",
]
# The 22 extended telemetry features (the reference computes and then drops them).
EXTENDED_FEATURES = [
    "fan_speed_mean", "fan_speed_max", "fan_speed_std", "high_fan_speed_pct",
    "sm_clock_mean", "sm_clock_std", "clock_stability", "memory_clock_std",
    "pcie_rx_mean_gbps", "pcie_tx_mean_gbps", "pcie_asymmetry_ratio",
    "nvlink_rx_mean_gbps", "nvlink_tx_mean_gbps", "nvlink_active_pct", "energy_kwh_per_hour",
    "ecc_sbe_rate_per_hour", "ecc_dbe_rate_per_hour", "memory_copy_util_mean", "memory_copy_util_max",
    "tensor_active_mean", "tensor_active_max", "tensor_usage_pct",
]


def _opt(df: DataFrame, name: str) -> Column:
    """Column if present, else NULL: optional telemetry (fan, NVLink, energy)."""
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def _two_sided(x: Column, mean: Column, std: Column) -> Column:
    return (x > mean + 2 * std) | (x < mean - 2 * std)


def gpu_features(metrics: DataFrame, assets: DataFrame, as_of=None, lookback: str = "7 days",
                 extended: bool = True, trend_bucket: str = "1 hour", stamp_last: bool = False) -> DataFrame:
    """One feature row per device with samples in ``[as_of - lookback, as_of]``.

    ``time`` is ``as_of``, or with ``stamp_last`` the device's last sample, as a store has
    it whose rows were computed when each device last reported.
    """
    a = as_of_col(metrics, as_of)
    rows = window_rows(metrics, a, lookback, strict=False)
    moments = {"temp": "gpu_temp", "pw": "power_usage", "sm": "sm_active", "occ": "sm_occupancy", "mem": "memory_utilization",
               "clk": "sm_clock_mhz", "mclk": "mem_clock_mhz", "rx": "pcie_rx_bytes_per_sec", "tx": "pcie_tx_bytes_per_sec",
               "nvrx": _opt(rows, "nvlink_rx_throughput"), "nvtx": _opt(rows, "nvlink_tx_throughput"),
               "en": _opt(rows, "total_energy_consumption"), "sbe": "ecc_sbe_aggregate", "dbe": "ecc_dbe_aggregate",
               "mcu": "mem_copy_utilization", "ta": "tensor_active"}
    counts = {
        "thermal_throttle_count": bit_set("throttle_reasons", BIT_HW_THERMAL, False),
        "power_brake_count": bit_set("throttle_reasons", BIT_HW_POWER_BRAKE, False),
        "sw_power_cap_count": bit_set("throttle_reasons", BIT_SW_POWER_CAP, False),
        "ecc_sbe_event_count": F.col("ecc_sbe_volatile") > 0, "ecc_dbe_event_count": F.col("ecc_dbe_volatile") > 0,
        "_throttle_rows": F.col("throttle_reasons") > 0, "_nv_active": _opt(rows, "nvlink_rx_throughput") > 1e9,
        "_ta_hi": F.col("tensor_active") > 50}
    parts = bucket_partials(rows, a, trend_bucket, [*[F.count_if(c).alias(k) for k, c in counts.items()], *moment_aggs(moments)],
                            trend="gpu_temp")
    g = combine(parts, [*[F.sum(k).alias(k) for k in counts], *combined_moments(moments)], trend=True)
    delta = lambda k: F.col(f"{k}__hi") - F.col(f"{k}__lo")
    g = g.select(
        "gpu_uuid", *counts, F.col("n").alias("_n"), F.col("last_us").alias("_last_us"),
        mean("temp").alias("gpu_temp_mean"), std("temp").alias("gpu_temp_std"), F.col("temp__lo").alias("gpu_temp_min"),
        F.col("temp__hi").alias("gpu_temp_max"),
        F.when(F.col("n") >= 3, F.col("slope")).otherwise(F.lit(0.0)).alias("gpu_temp_trend"),
        mean("pw").alias("power_usage_mean"), std("pw").alias("power_usage_std"),
        mean("sm").alias("sm_active_mean"), std("sm").alias("sm_active_std"), mean("occ").alias("sm_occupancy_mean"),
        mean("mem").alias("memory_util_mean"), std("mem").alias("memory_util_std"),
        F.col("clk__n").alias("_clk_n"), mean("clk").alias("_clk_mean"), std("clk").alias("_clk_std"),
        F.col("mclk__n").alias("_mclk_n"), std("mclk").alias("_mclk_std"),
        F.col("rx__n").alias("_rx_n"), mean("rx").alias("_rx_mean"), mean("tx").alias("_tx_mean"),
        F.col("nvrx__n").alias("_nv_n"), mean("nvrx").alias("_nvrx_mean"), mean("nvtx").alias("_nvtx_mean"),
        F.col("en__n").alias("_en_n"), delta("en").alias("_en_delta"), F.col("sbe__n").alias("_sbe_n"),
        delta("sbe").alias("_sbe_delta"), delta("dbe").alias("_dbe_delta"),
        ((F.col("last_us") - F.col("first_us")) / F.lit(3.6e9)).alias("_span_h"),
        F.col("mcu__n").alias("_mcu_n"), mean("mcu").alias("_mcu_mean"), F.col("mcu__hi").alias("_mcu_max"),
        F.col("ta__n").alias("_ta_n"), mean("ta").alias("_ta_mean"), F.col("ta__hi").alias("_ta_max"))
    # packed by an aggregate, which column pruning does not see through: both uses of g below
    # are then one plan, and Spark runs its shuffles once
    g = g.groupBy("gpu_uuid").agg(F.first(F.struct(*[c for c in g.columns if c != "gpu_uuid"])).alias("s")).select("gpu_uuid", "s.*")
    # two-sided 2-sigma outlier counts: per-device mean/std joined back to the rows
    ms = g.select("gpu_uuid", "gpu_temp_mean", "gpu_temp_std", "power_usage_mean", "power_usage_std")
    out = (rows.select("gpu_uuid", "gpu_temp", "power_usage").join(ms, "gpu_uuid", "inner")
               .groupBy("gpu_uuid").agg(
                   F.count_if(_two_sided(F.col("gpu_temp"), F.col("gpu_temp_mean"), F.col("gpu_temp_std")))
                    .alias("_temp_out"),
                   F.count_if(_two_sided(F.col("power_usage"), F.col("power_usage_mean"), F.col("power_usage_std")))
                    .alias("_power_out")))
    meta = assets.select("gpu_uuid", "model", "deployment_date", "warranty_expiry")
    f = g.join(out, "gpu_uuid", "left").join(meta, "gpu_uuid", "left")

    zero = F.lit(0.0)
    pm = F.col("power_usage_mean")
    age = F.when(F.col("deployment_date").isNotNull(), days_floor(a, F.col("deployment_date"))).otherwise(F.lit(0))
    warranty = F.when(F.col("warranty_expiry").isNotNull(),
                      days_floor(F.col("warranty_expiry"), a)).otherwise(F.lit(0))
    has_asset = F.col("model").isNotNull()
    cols = {
        "gpu_temp_mean": F.col("gpu_temp_mean"), "gpu_temp_std": F.col("gpu_temp_std"),
        "gpu_temp_min": F.col("gpu_temp_min"), "gpu_temp_max": F.col("gpu_temp_max"),
        "gpu_temp_trend": F.coalesce(F.col("gpu_temp_trend"), zero),
        "power_usage_mean": pm, "power_usage_std": F.col("power_usage_std"),
        "power_usage_cv": F.when(pm > 0, F.col("power_usage_std") / pm).otherwise(zero),
        "power_efficiency": F.when(pm > 0, F.col("sm_active_mean") / pm).otherwise(zero),
        "sm_active_mean": F.col("sm_active_mean"), "sm_active_std": F.col("sm_active_std"),
        "sm_occupancy_mean": F.col("sm_occupancy_mean"),
        "memory_util_mean": F.col("memory_util_mean"), "memory_util_std": F.col("memory_util_std"),
        "thermal_throttle_count": F.col("thermal_throttle_count").cast("int"),
        "power_brake_count": F.col("power_brake_count").cast("int"),
        "sw_power_cap_count": F.col("sw_power_cap_count").cast("int"),
        "ecc_sbe_event_count": F.col("ecc_sbe_event_count").cast("int"),
        "ecc_dbe_event_count": F.col("ecc_dbe_event_count").cast("int"),
        "temp_spike_count": F.when(F.col("gpu_temp_std") > 0, F.col("_temp_out")).otherwise(0).cast("int"),
        "power_anomaly_count": F.when(F.col("power_usage_std") > 0, F.col("_power_out")).otherwise(0).cast("int"),
        "throttle_duration_hours": F.col("_throttle_rows") * float(SAMPLE_SECONDS) / 3600.0,
        "gpu_age_days": F.when(has_asset, age).otherwise(F.lit(0)).cast("int"),
        "warranty_remaining_days": F.when(has_asset, warranty).otherwise(F.lit(0)).cast("int"),
        "total_operating_hours": F.when(has_asset & (age > 0), age * 24.0).otherwise(zero),
        "model_a100": F.coalesce(F.col("model").contains("A100"), F.lit(False)),
        "model_h100": F.coalesce(F.col("model").contains("H100"), F.lit(False)),
    }
    if extended:
        clk = F.col("_clk_mean")
        span = F.col("_span_h")
        rx_g, tx_g = F.col("_rx_mean") / 1e9, F.col("_tx_mean") / 1e9
        cols.update({
            "fan_speed_mean": zero, "fan_speed_max": zero, "fan_speed_std": zero, "high_fan_speed_pct": zero,
            "sm_clock_mean": F.when(F.col("_clk_n") > 0, clk).otherwise(zero),
            "sm_clock_std": F.when(F.col("_clk_n") > 0, F.col("_clk_std")).otherwise(zero),
            "clock_stability": F.when((F.col("_clk_n") > 0) & (clk > 0), F.lit(1.0) - F.col("_clk_std") / clk)
                                .otherwise(F.lit(1.0)),
            "memory_clock_std": F.when(F.col("_mclk_n") > 0, F.col("_mclk_std")).otherwise(zero),
            "pcie_rx_mean_gbps": F.when(F.col("_rx_n") > 0, rx_g).otherwise(zero),
            "pcie_tx_mean_gbps": F.when(F.col("_rx_n") > 0, F.coalesce(tx_g, zero)).otherwise(zero),
            "pcie_asymmetry_ratio": F.when((F.col("_rx_n") > 0) & (tx_g > 0), rx_g / tx_g).otherwise(zero),
            "nvlink_rx_mean_gbps": F.when(F.col("_nv_n") > 0, F.col("_nvrx_mean") / 1e9).otherwise(zero),
            "nvlink_tx_mean_gbps": F.when(F.col("_nv_n") > 0, F.coalesce(F.col("_nvtx_mean") / 1e9, zero))
                                    .otherwise(zero),
            "nvlink_active_pct": F.when(F.col("_nv_n") > 0, F.col("_nv_active") / F.col("_n") * 100.0).otherwise(zero),
            "energy_kwh_per_hour": F.when((F.col("_en_n") > 0) & (span > 0), F.col("_en_delta") / 1e6 / span)
                                    .otherwise(zero),
            "ecc_sbe_rate_per_hour": F.when((F.col("_sbe_n") > 0) & (span > 0), F.col("_sbe_delta") / span)
                                      .otherwise(zero),
            "ecc_dbe_rate_per_hour": F.when((F.col("_sbe_n") > 0) & (span > 0), F.col("_dbe_delta") / span)
                                      .otherwise(zero),
            "memory_copy_util_mean": F.when(F.col("_mcu_n") > 0, F.col("_mcu_mean")).otherwise(zero),
            "memory_copy_util_max": F.when(F.col("_mcu_n") > 0, F.col("_mcu_max")).otherwise(zero),
            "tensor_active_mean": F.when(F.col("_ta_n") > 0, F.col("_ta_mean")).otherwise(zero),
            "tensor_active_max": F.when(F.col("_ta_n") > 0, F.col("_ta_max")).otherwise(zero),
            "tensor_usage_pct": F.when(F.col("_ta_n") > 0, F.col("_ta_hi") / F.col("_n") * 100.0).otherwise(zero),
        })
    at = F.timestamp_micros("_last_us") if stamp_last else a
    return f.select(at.alias("time"), "gpu_uuid", *[c.alias(k) for k, c in cols.items()],
                    F.lit(FEATURE_VERSION).alias("feature_version"), a.alias("computed_at"))


def project_to_table(df: DataFrame, table_columns) -> DataFrame:
    """Keep only the target table's columns, in its order (PRJ20)."""
    return df.select(*[c for c in table_columns if c in df.columns])

"""Registered analytics queries: anomalies, health scores, features, predictions,
economics, alerts, with their DuckDB oracles (driver windows, see DRIVER_PARAMS)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fleetscope.functions.timewin import as_of_col
from fleetscope.operators import alerts, anomaly, economics, features, health, ordered, predict
from fleetscope.plans.catalog import DRIVER_PARAMS as P
from fleetscope.plans.catalog import finish, register, rnd
from fleetscope.plans.oracle import sql
from fleetscope.sources.driver import load_fleet

LB = P["lookback_days"]
EXPECTED = LB * 86400.0 / P["sample_seconds"]


def r(expr: str, n: int) -> str:
    """SQL twin of ``round_half_up``."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,12)), {n}) AS DOUBLE)"


# ---------------------------------------------------------------- anomalies
BASELINE_CTE = f"""
bstats AS (
  SELECT gpu_uuid, avg(gpu_temp) AS temp_mean, stddev_samp(gpu_temp) AS temp_std,
    avg(power_usage) AS power_mean, stddev_samp(power_usage) AS power_std,
    avg(sm_active) AS sm_mean, stddev_samp(sm_active) AS sm_std,
    avg(memory_utilization) AS mem_util_mean, stddev_samp(memory_utilization) AS mem_util_std
  FROM gpu_metrics, as_of WHERE time >= as_of - INTERVAL '{P['baseline']}' AND time <= as_of GROUP BY gpu_uuid)"""

ANOMALY_CTE = BASELINE_CTE + f""",
arec AS (SELECT time, gpu_uuid, gpu_temp, power_usage, sm_active FROM gpu_metrics, as_of
         WHERE time >= as_of - INTERVAL '{P['recent']}' AND time <= as_of),
az AS (
  SELECT arec.*, bstats.*,
    CASE WHEN temp_std > 0 THEN abs((gpu_temp - temp_mean) / temp_std) ELSE 0.0 END AS tz,
    CASE WHEN power_std > 0 THEN abs((power_usage - power_mean) / power_std) ELSE 0.0 END AS pz,
    CASE WHEN sm_std > 0 THEN abs((sm_active - sm_mean) / sm_std) ELSE 0.0 END AS sz
  FROM arec JOIN bstats USING (gpu_uuid) WHERE temp_std IS NOT NULL),
anomalies AS (
  SELECT time, gpu_uuid, 'temperature' AS anomaly_type, gpu_temp AS value, {r('tz', 2)} AS z_score,
         {r('temp_mean', 2)} AS baseline_mean, CASE WHEN tz > 4 THEN 'high' ELSE 'medium' END AS severity
  FROM az WHERE tz > 3.0
  UNION ALL
  SELECT time, gpu_uuid, 'power_usage', power_usage, {r('pz', 2)}, {r('power_mean', 2)},
         CASE WHEN pz > 4 THEN 'medium' ELSE 'low' END FROM az WHERE pz > 3.0
  UNION ALL
  SELECT time, gpu_uuid, 'utilization', sm_active, {r('sz', 2)}, {r('sm_mean', 2)}, 'low' FROM az WHERE sz > 3.0)"""


def _anoms(spark, sf):
    m = load_fleet(spark, sf)["metrics"]
    a = as_of_col(m)
    return m, a, anomaly.detect_anomalies(m, a, P["baseline"], P["recent"], 3.0)


@register("agg12_baseline_stats", sql(rnd("SELECT * FROM bstats", [
    "temp_mean", "temp_std", "power_mean", "power_std", "sm_mean", "sm_std", "mem_util_mean", "mem_util_std"]),
    BASELINE_CTE))
def agg12_baseline_stats(spark, sf):
    m = load_fleet(spark, sf)["metrics"]
    return finish(anomaly.baseline_stats(m, as_of_col(m), P["baseline"]))


@register("ana02_anomalies", sql(rnd("""
SELECT a.*, o.as_of AS detected_at, FALSE AS acknowledged, CAST(NULL AS TIMESTAMP) AS acknowledged_at,
       CAST(NULL AS VARCHAR) AS acknowledged_by FROM anomalies a, as_of o""", ["value"]), ANOMALY_CTE))
def ana02_anomalies(spark, sf):
    return finish(_anoms(spark, sf)[2])


@register("agg16_anomaly_counts", sql("""
SELECT gpu_uuid, count(*) AS anomalies_detected FROM anomalies GROUP BY 1""", ANOMALY_CTE))
def agg16_anomaly_counts(spark, sf):
    m, a, an = _anoms(spark, sf)
    return anomaly.anomaly_counts(an, a, "1 hour")


@register("prj16_severity_levels", sql("""
SELECT gpu_uuid, time, anomaly_type, o.as_of AS detected_at,
  CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END
    AS severity_level
FROM anomalies, as_of o""", ANOMALY_CTE))
def prj16_severity_levels(spark, sf):
    m, a, an = _anoms(spark, sf)
    return anomaly.severity_timeline(an, a, "6 hours")


# ---------------------------------------------------------------- health
HEALTH_CTE = f"""
hw AS (SELECT m.* FROM gpu_metrics m, as_of a
       WHERE m.time > a.as_of - INTERVAL '{LB} days' AND m.time <= a.as_of),
hact AS (SELECT DISTINCT gpu_uuid FROM gpu_metrics, as_of
         WHERE time > as_of - INTERVAL '{P['active']}' AND time <= as_of),
hg AS (
  SELECT gpu_uuid, count(*) AS n,
    CAST(arg_max(ecc_dbe_volatile, time) AS DOUBLE) AS l_dbe, CAST(arg_max(ecc_sbe_volatile, time) AS DOUBLE) AS l_sbe,
    CAST(arg_max(retired_pages_dbe, time) AS DOUBLE) AS l_ret,
    count(gpu_temp) AS temp_n, avg(gpu_temp) AS temp_avg, max(gpu_temp) AS temp_max, stddev_pop(gpu_temp) AS temp_std,
    count_if(coalesce(throttle_reasons, 0) > 0) AS throttle_rows,
    count_if((coalesce(throttle_reasons, 0) & 64) > 0) AS hw_thermal_rows,
    count_if((coalesce(throttle_reasons, 0) & 128) > 0) AS power_brake_rows,
    count_if((coalesce(throttle_reasons, 0) & 4) > 0) AS sw_cap_rows,
    count(sm_active) AS sm_n, avg(sm_active) AS sm_avg, count(sm_occupancy) AS occ_n, avg(sm_occupancy) AS occ_avg,
    count(power_usage) AS pw_n, avg(power_usage) AS pw_avg, stddev_pop(power_usage) AS pw_std
  FROM hw GROUP BY gpu_uuid),
hr AS (SELECT gpu_uuid, coalesce(dram_active, 0.0) AS dram,
         row_number() OVER (PARTITION BY gpu_uuid ORDER BY time) AS rn_a,
         row_number() OVER (PARTITION BY gpu_uuid ORDER BY time DESC) AS rn_d,
         epoch_us(time) - epoch_us(lag(time) OVER (PARTITION BY gpu_uuid ORDER BY time)) AS dt_us
       FROM hw),
hht AS (SELECT gpu_uuid, sum(CASE WHEN rn_a <= 24 THEN dram ELSE 0.0 END) AS head_sum,
          sum(CASE WHEN rn_d <= 24 THEN dram ELSE 0.0 END) AS tail_sum,
          count_if(dt_us > {int(P['gap_seconds'] * 1_000_000)}) AS gap_count
        FROM hr GROUP BY gpu_uuid),
hs AS (SELECT *, coalesce(head_sum, 0.0) / CAST(least(24, n) AS DOUBLE) AS hb,
              coalesce(tail_sum, 0.0) / CAST(least(24, n) AS DOUBLE) AS tb
       FROM hact LEFT JOIN hg USING (gpu_uuid) LEFT JOIN hht USING (gpu_uuid)),
hd AS (
  SELECT *,
    greatest(0.0, least(100.0, 100.0
      - CASE WHEN coalesce(l_dbe, 0) > 0 THEN least(50.0, coalesce(l_dbe, 0) * 10.0) ELSE 0.0 END
      - CASE WHEN coalesce(l_sbe, 0) > 100 THEN least(20.0, (coalesce(l_sbe, 0) - 100) / 100.0 * 20.0) ELSE 0.0 END
      - CASE WHEN coalesce(l_ret, 0) > 0 THEN least(30.0, coalesce(l_ret, 0) * 5.0) ELSE 0.0 END
      - CASE WHEN n > 1 AND hb > 0 AND (hb - tb) / hb > 0.1 THEN (hb - tb) / hb * 100.0 ELSE 0.0 END)) AS m,
    CASE WHEN temp_n = 0 THEN 0.0 ELSE greatest(0.0, least(100.0, 100.0
      - CASE WHEN temp_avg > 85 THEN (temp_avg - 85) * 2.0 WHEN temp_avg > 75 THEN temp_avg - 75
             WHEN temp_avg < 30 THEN (30 - temp_avg) * 0.5 ELSE 0.0 END
      - CASE WHEN temp_max > 95 THEN (temp_max - 95) * 3.0 ELSE 0.0 END
      - CASE WHEN temp_n > 1 AND temp_std > 10 THEN (temp_std - 10) * 0.5 ELSE 0.0 END
      - CASE WHEN throttle_rows / n * 100.0 > 5 THEN throttle_rows / n * 100.0 ELSE 0.0 END
      - CASE WHEN hw_thermal_rows > 0 THEN 20.0 ELSE 0.0 END)) END AS t,
    CASE WHEN sm_n = 0 THEN 100.0 ELSE greatest(0.0, least(100.0, 100.0
      - CASE WHEN occ_n > 0 AND sm_avg > 10 AND occ_avg < 30 THEN (30 - occ_avg) * 0.5 ELSE 0.0 END)) END AS p,
    CASE WHEN pw_n = 0 THEN 100.0 ELSE greatest(0.0, least(100.0, 100.0
      - CASE WHEN pw_n > 1 AND pw_avg > 0 AND pw_std / pw_avg > 0.2 THEN (pw_std / pw_avg - 0.2) * 100.0 ELSE 0.0 END
      - CASE WHEN power_brake_rows > 0 THEN 15.0 ELSE 0.0 END
      - CASE WHEN sw_cap_rows > n * 0.5 THEN 10.0 ELSE 0.0 END)) END AS w,
    greatest(0.0, least(100.0, 100.0
      - CASE WHEN n / {EXPECTED!r} < 0.95 THEN (0.95 - n / {EXPECTED!r}) * 100.0 ELSE 0.0 END
      - CASE WHEN n > 1 THEN coalesce(gap_count, 0) * 5.0 ELSE 0.0 END)) AS rl
  FROM hs),
health AS (
  SELECT o.as_of AS time, gpu_uuid,
    CASE WHEN n IS NULL THEN 0.0 ELSE {r('m * 0.3 + t * 0.25 + p * 0.2 + w * 0.15 + rl * 0.1', 1)} END AS overall_score,
    CASE WHEN n IS NULL THEN 'unknown'
         WHEN m * 0.3 + t * 0.25 + p * 0.2 + w * 0.15 + rl * 0.1 >= 90 THEN 'excellent'
         WHEN m * 0.3 + t * 0.25 + p * 0.2 + w * 0.15 + rl * 0.1 >= 80 THEN 'good'
         WHEN m * 0.3 + t * 0.25 + p * 0.2 + w * 0.15 + rl * 0.1 >= 70 THEN 'fair'
         WHEN m * 0.3 + t * 0.25 + p * 0.2 + w * 0.15 + rl * 0.1 >= 60 THEN 'degraded'
         WHEN m * 0.3 + t * 0.25 + p * 0.2 + w * 0.15 + rl * 0.1 >= 50 THEN 'poor' ELSE 'critical' END
      AS health_grade,
    CASE WHEN n IS NULL THEN 0.0 ELSE {r('m', 1)} END AS memory_health,
    CASE WHEN n IS NULL THEN 0.0 ELSE {r('t', 1)} END AS thermal_health,
    CASE WHEN n IS NULL THEN 0.0 ELSE {r('p', 1)} END AS performance_health,
    CASE WHEN n IS NULL THEN 0.0 ELSE {r('w', 1)} END AS power_health,
    CASE WHEN n IS NULL THEN 0.0 ELSE {r('rl', 1)} END AS reliability_health,
    CAST(NULL AS DOUBLE) AS score_delta_7d, CAST(NULL AS DOUBLE) AS score_delta_30d,
    CAST(NULL AS DOUBLE) AS degradation_rate,
    CASE WHEN n IS NULL THEN '["no_data"]' ELSE to_json(list_filter([
      CASE WHEN coalesce(l_dbe, 0) > 0 THEN 'uncorrectable_ecc_errors' END,
      CASE WHEN coalesce(l_sbe, 0) > 100 THEN 'high_correctable_ecc_errors' END,
      CASE WHEN temp_n > 0 AND temp_avg > 80 THEN 'elevated_temperature' END,
      CASE WHEN hw_thermal_rows > 0 THEN 'thermal_throttling' END,
      CASE WHEN coalesce(l_ret, 0) > 0 THEN 'retired_memory_pages' END,
      CASE WHEN m < 70 THEN 'memory_degradation' END,
      CASE WHEN t < 70 THEN 'thermal_issues' END,
      CASE WHEN p < 70 THEN 'performance_degradation' END], lambda x: x IS NOT NULL))::VARCHAR END
      AS degradation_factors,
    '1.0' AS scoring_version
  FROM hd, as_of o)"""


def _health(spark, sf):
    t = load_fleet(spark, sf)
    m = t["metrics"]
    a = as_of_col(m)
    h = health.health_scores(m, a, LB, P["active"], P["gap_seconds"], P["sample_seconds"], gap_bucket="1 day")
    return t, a, h


def _as_json(df, col="degradation_factors"):
    return df.withColumn(col, F.to_json(F.col(col)))


@register("ana01_health_scores", sql("SELECT * FROM health", HEALTH_CTE))
def ana01_health_scores(spark, sf):
    return _as_json(_health(spark, sf)[2])


@register("win02_gap_counts", sql(f"""
SELECT gpu_uuid, CAST(count_if(dt_us > {int(P['gap_seconds'] * 1_000_000)}) AS INTEGER) AS gap_count
FROM (SELECT gpu_uuid, epoch_us(time) - epoch_us(lag(time) OVER (PARTITION BY gpu_uuid ORDER BY time)) AS dt_us
      FROM gpu_metrics) GROUP BY 1"""))
def win02_gap_counts(spark, sf):
    m = load_fleet(spark, sf)["metrics"]
    return ordered.gap_counts(m, "gpu_uuid", "time", P["gap_seconds"]) \
                  .withColumn("gap_count", F.col("gap_count").cast("int"))


@register("win03_head_tail_dram", sql(rnd("""
SELECT gpu_uuid, count(*) AS n,
  sum(CASE WHEN rn_a <= 24 THEN coalesce(dram_active, 0.0) ELSE 0.0 END) / least(24, count(*)) AS head_mean,
  sum(CASE WHEN rn_d <= 24 THEN coalesce(dram_active, 0.0) ELSE 0.0 END) / least(24, count(*)) AS tail_mean
FROM (SELECT gpu_uuid, dram_active, row_number() OVER (PARTITION BY gpu_uuid ORDER BY time) AS rn_a,
             row_number() OVER (PARTITION BY gpu_uuid ORDER BY time DESC) AS rn_d FROM gpu_metrics)
GROUP BY 1""", ["head_mean", "tail_mean"])))
def win03_head_tail_dram(spark, sf):
    m = load_fleet(spark, sf)["metrics"]
    from fleetscope.operators.latest import first_n_per_key, latest_n_per_key
    d = m.select("gpu_uuid", "time", F.coalesce(F.col("dram_active"), F.lit(0.0)).alias("dram"))
    n = m.groupBy("gpu_uuid").agg(F.count(F.lit(1)).alias("n"))
    hd = first_n_per_key(d, 24).groupBy("gpu_uuid").agg(F.sum("dram").alias("_h"))
    tl = latest_n_per_key(d, 24).groupBy("gpu_uuid").agg(F.sum("dram").alias("_t"))
    k = F.least(F.lit(24), F.col("n")).cast("double")
    return finish(n.join(hd, "gpu_uuid").join(tl, "gpu_uuid")
                  .select("gpu_uuid", "n", (F.col("_h") / k).alias("head_mean"), (F.col("_t") / k).alias("tail_mean")))


# ---------------------------------------------------------------- features
FEATURE_CTE = f"""
fw AS (SELECT m.* FROM gpu_metrics m, as_of a WHERE m.time >= a.as_of - INTERVAL '{LB} days' AND m.time <= a.as_of),
fg AS (
  SELECT gpu_uuid, count(*) AS n,
    avg(gpu_temp) AS gpu_temp_mean, stddev_samp(gpu_temp) AS gpu_temp_std, min(gpu_temp) AS gpu_temp_min,
    max(gpu_temp) AS gpu_temp_max, avg(power_usage) AS power_usage_mean, stddev_samp(power_usage) AS power_usage_std,
    avg(sm_active) AS sm_active_mean, stddev_samp(sm_active) AS sm_active_std, avg(sm_occupancy) AS sm_occupancy_mean,
    avg(memory_utilization) AS memory_util_mean, stddev_samp(memory_utilization) AS memory_util_std,
    count_if((throttle_reasons & 64) > 0) AS thermal_throttle_count,
    count_if((throttle_reasons & 128) > 0) AS power_brake_count,
    count_if((throttle_reasons & 4) > 0) AS sw_power_cap_count,
    count_if(ecc_sbe_volatile > 0) AS ecc_sbe_event_count, count_if(ecc_dbe_volatile > 0) AS ecc_dbe_event_count,
    count_if(throttle_reasons > 0) AS throttle_rows,
    count(sm_clock_mhz) AS clk_n, avg(sm_clock_mhz) AS clk_mean, stddev_samp(sm_clock_mhz) AS clk_std,
    count(mem_clock_mhz) AS mclk_n, stddev_samp(mem_clock_mhz) AS mclk_std,
    count(pcie_rx_bytes_per_sec) AS rx_n, avg(pcie_rx_bytes_per_sec) AS rx_mean, avg(pcie_tx_bytes_per_sec) AS tx_mean,
    count(ecc_sbe_aggregate) AS sbe_n, max(ecc_sbe_aggregate) - min(ecc_sbe_aggregate) AS sbe_delta,
    max(ecc_dbe_aggregate) - min(ecc_dbe_aggregate) AS dbe_delta,
    (epoch_us(max(time)) - epoch_us(min(time))) / 3600000000.0::DOUBLE AS span_h,
    count(mem_copy_utilization) AS mcu_n, avg(mem_copy_utilization) AS mcu_mean, max(mem_copy_utilization) AS mcu_max,
    count(tensor_active) AS ta_n, avg(tensor_active) AS ta_mean, max(tensor_active) AS ta_max,
    count_if(tensor_active > 50) AS ta_hi
  FROM fw GROUP BY gpu_uuid),
fo AS (SELECT fw.gpu_uuid,
    count_if(fw.gpu_temp > fg.gpu_temp_mean + 2 * fg.gpu_temp_std OR fw.gpu_temp < fg.gpu_temp_mean - 2 * fg.gpu_temp_std)
      AS temp_out,
    count_if(fw.power_usage > fg.power_usage_mean + 2 * fg.power_usage_std
             OR fw.power_usage < fg.power_usage_mean - 2 * fg.power_usage_std) AS power_out
  FROM fw JOIN fg USING (gpu_uuid) GROUP BY 1),
ft AS (SELECT gpu_uuid, count(*) AS tn, regr_slope(gpu_temp, CAST(rn - 1 AS DOUBLE)) AS slope
       FROM (SELECT gpu_uuid, gpu_temp, row_number() OVER (PARTITION BY gpu_uuid ORDER BY time) AS rn FROM fw)
       GROUP BY 1),
fa AS (SELECT f.*, t.tn, t.slope, o.temp_out, o.power_out, a.model, a.deployment_date, a.warranty_expiry,
         CAST(floor((epoch_us(x.as_of) - epoch_us(CAST(a.deployment_date AS TIMESTAMP))) / 1000000.0::DOUBLE
                    / 86400.0::DOUBLE) AS INTEGER) AS age,
         CAST(floor((epoch_us(CAST(a.warranty_expiry AS TIMESTAMP)) - epoch_us(x.as_of)) / 1000000.0::DOUBLE
                    / 86400.0::DOUBLE) AS INTEGER) AS wdays, x.as_of
       FROM fg f LEFT JOIN fo o USING (gpu_uuid) LEFT JOIN ft t USING (gpu_uuid)
       LEFT JOIN gpu_assets a USING (gpu_uuid), as_of x),
features AS (
  SELECT as_of AS time, gpu_uuid, gpu_temp_mean, gpu_temp_std, gpu_temp_min, gpu_temp_max,
    coalesce(CASE WHEN tn >= 3 THEN slope ELSE 0.0 END, 0.0) AS gpu_temp_trend,
    power_usage_mean, power_usage_std,
    CASE WHEN power_usage_mean > 0 THEN power_usage_std / power_usage_mean ELSE 0.0 END AS power_usage_cv,
    CASE WHEN power_usage_mean > 0 THEN sm_active_mean / power_usage_mean ELSE 0.0 END AS power_efficiency,
    sm_active_mean, sm_active_std, sm_occupancy_mean, memory_util_mean, memory_util_std,
    CAST(thermal_throttle_count AS INTEGER) AS thermal_throttle_count,
    CAST(power_brake_count AS INTEGER) AS power_brake_count, CAST(sw_power_cap_count AS INTEGER) AS sw_power_cap_count,
    CAST(ecc_sbe_event_count AS INTEGER) AS ecc_sbe_event_count,
    CAST(ecc_dbe_event_count AS INTEGER) AS ecc_dbe_event_count,
    CAST(CASE WHEN gpu_temp_std > 0 THEN temp_out ELSE 0 END AS INTEGER) AS temp_spike_count,
    CAST(CASE WHEN power_usage_std > 0 THEN power_out ELSE 0 END AS INTEGER) AS power_anomaly_count,
    throttle_rows * 10.0 / 3600.0 AS throttle_duration_hours,
    CAST(CASE WHEN model IS NOT NULL AND deployment_date IS NOT NULL THEN age ELSE 0 END AS INTEGER) AS gpu_age_days,
    CAST(CASE WHEN model IS NOT NULL AND warranty_expiry IS NOT NULL THEN wdays ELSE 0 END AS INTEGER)
      AS warranty_remaining_days,
    CASE WHEN model IS NOT NULL AND deployment_date IS NOT NULL AND age > 0 THEN age * 24.0 ELSE 0.0 END
      AS total_operating_hours,
    coalesce(contains(model, 'A100'), FALSE) AS model_a100, coalesce(contains(model, 'H100'), FALSE) AS model_h100,
    0.0 AS fan_speed_mean, 0.0 AS fan_speed_max, 0.0 AS fan_speed_std, 0.0 AS high_fan_speed_pct,
    CASE WHEN clk_n > 0 THEN clk_mean ELSE 0.0 END AS sm_clock_mean,
    CASE WHEN clk_n > 0 THEN clk_std ELSE 0.0 END AS sm_clock_std,
    CASE WHEN clk_n > 0 AND clk_mean > 0 THEN 1.0 - clk_std / clk_mean ELSE 1.0 END AS clock_stability,
    CASE WHEN mclk_n > 0 THEN mclk_std ELSE 0.0 END AS memory_clock_std,
    CASE WHEN rx_n > 0 THEN rx_mean / 1e9 ELSE 0.0 END AS pcie_rx_mean_gbps,
    CASE WHEN rx_n > 0 THEN coalesce(tx_mean / 1e9, 0.0) ELSE 0.0 END AS pcie_tx_mean_gbps,
    CASE WHEN rx_n > 0 AND tx_mean / 1e9 > 0 THEN (rx_mean / 1e9) / (tx_mean / 1e9) ELSE 0.0 END AS pcie_asymmetry_ratio,
    0.0 AS nvlink_rx_mean_gbps, 0.0 AS nvlink_tx_mean_gbps, 0.0 AS nvlink_active_pct, 0.0 AS energy_kwh_per_hour,
    CASE WHEN sbe_n > 0 AND span_h > 0 THEN sbe_delta / span_h ELSE 0.0 END AS ecc_sbe_rate_per_hour,
    CASE WHEN sbe_n > 0 AND span_h > 0 THEN dbe_delta / span_h ELSE 0.0 END AS ecc_dbe_rate_per_hour,
    CASE WHEN mcu_n > 0 THEN mcu_mean ELSE 0.0 END AS memory_copy_util_mean,
    CASE WHEN mcu_n > 0 THEN mcu_max ELSE 0.0 END AS memory_copy_util_max,
    CASE WHEN ta_n > 0 THEN ta_mean ELSE 0.0 END AS tensor_active_mean,
    CASE WHEN ta_n > 0 THEN ta_max ELSE 0.0 END AS tensor_active_max,
    CASE WHEN ta_n > 0 THEN ta_hi / n * 100.0 ELSE 0.0 END AS tensor_usage_pct,
    '1.0' AS feature_version, as_of AS computed_at
  FROM fa)"""

FEATURE_DOUBLES = [c for c in features.STORED_FEATURES + features.EXTENDED_FEATURES
                   if not c.endswith("_count") and c not in ("gpu_age_days", "warranty_remaining_days",
                                                            "model_a100", "model_h100")]


def _features(spark, sf):
    t = load_fleet(spark, sf)
    m = t["metrics"]
    a = as_of_col(m)
    return t, a, features.gpu_features(m, t["assets"], a, f"{LB} days", extended=True, trend_bucket="1 day")


@register("ana03_features", sql(rnd("SELECT * FROM features", FEATURE_DOUBLES), FEATURE_CTE))
def ana03_features(spark, sf):
    return finish(_features(spark, sf)[2])


@register("agg19_temp_trend_slope", sql(rnd("""
SELECT gpu_uuid, CASE WHEN count(*) >= 3 THEN regr_slope(gpu_temp, CAST(rn - 1 AS DOUBLE)) ELSE 0.0 END AS slope
FROM (SELECT gpu_uuid, gpu_temp, row_number() OVER (PARTITION BY gpu_uuid ORDER BY time) AS rn FROM gpu_metrics)
GROUP BY 1""", ["slope"])))
def agg19_temp_trend_slope(spark, sf):
    m = load_fleet(spark, sf)["metrics"]
    return finish(ordered.index_slope(m, "gpu_temp", "gpu_uuid", "time"))


# ---------------------------------------------------------------- predictions
PREDICT_CTE = FEATURE_CTE + f""",
fp AS (SELECT *, least(
    CASE WHEN coalesce(gpu_temp_mean, 70.0) > 85 THEN 0.4 WHEN coalesce(gpu_temp_mean, 70.0) > 80 THEN 0.2
         WHEN coalesce(gpu_temp_mean, 70.0) > 75 THEN 0.1 ELSE 0.0 END
    + CASE WHEN coalesce(thermal_throttle_count, 0) > 20 THEN 0.3
           WHEN coalesce(thermal_throttle_count, 0) > 10 THEN 0.15 ELSE 0.0 END
    + CASE WHEN coalesce(ecc_dbe_event_count, 0) > 0 THEN 0.5 ELSE 0.0 END
    + CASE WHEN coalesce(ecc_sbe_event_count, 0) > 100 THEN 0.2 ELSE 0.0 END
    + CASE WHEN coalesce(gpu_age_days, 0) > 1095 THEN 0.2 WHEN coalesce(gpu_age_days, 0) > 730 THEN 0.1 ELSE 0.0 END,
    0.95) AS p30,
    CASE WHEN coalesce(ecc_dbe_event_count, 0) > 0 THEN 0.5 ELSE 0.0 END
      + CASE WHEN coalesce(ecc_sbe_event_count, 0) > 50 THEN 0.3 ELSE 0.0 END AS s_mem,
    CASE WHEN coalesce(gpu_temp_mean, 70.0) > 85 THEN 0.4 ELSE 0.0 END
      + CASE WHEN coalesce(thermal_throttle_count, 0) > 20 THEN 0.4 ELSE 0.0 END AS s_th,
    CASE WHEN coalesce(power_brake_count, 0) > 10 THEN 0.5 ELSE 0.0 END AS s_pw
  FROM features),
predictions AS (  -- devices whose features are older than the active span get none
  SELECT time, gpu_uuid, {r('p30 * 0.25', 4)} AS failure_prob_7d, {r('p30', 4)} AS failure_prob_30d,
    {r('least(p30 * 2.5, 0.99)', 4)} AS failure_prob_90d,
    CASE WHEN s_mem = greatest(greatest(s_mem, s_th, s_pw), CASE WHEN greatest(s_mem, s_th, s_pw) < 0.1 THEN 1.0 ELSE 0.0 END) THEN 'memory'
         WHEN s_th = greatest(greatest(s_mem, s_th, s_pw), CASE WHEN greatest(s_mem, s_th, s_pw) < 0.1 THEN 1.0 ELSE 0.0 END) THEN 'thermal'
         WHEN s_pw = greatest(greatest(s_mem, s_th, s_pw), CASE WHEN greatest(s_mem, s_th, s_pw) < 0.1 THEN 1.0 ELSE 0.0 END) THEN 'power'
         ELSE 'other' END AS predicted_failure_type,
    CAST(CASE WHEN p30 > 0.1 THEN floor(30.0 / p30) ELSE 365 END AS INTEGER) AS estimated_ttf_days,
    'heuristic' AS model_name, '1.0' AS model_version, 0.6::DOUBLE AS confidence, CAST(NULL AS VARCHAR) AS feature_importance, time AS predicted_at
  FROM fp JOIN (SELECT gpu_uuid, max(time) AS last_sample FROM fw GROUP BY 1) USING (gpu_uuid)
  WHERE last_sample >= time - INTERVAL '{P['active']}')"""


def _predictions(spark, sf):
    t = load_fleet(spark, sf)
    a = as_of_col(t["metrics"])
    f = features.gpu_features(t["metrics"], t["assets"], a, f"{LB} days", trend_bucket="1 day", stamp_last=True)
    return t, a, predict.predict_failures(f, a, active=P["active"])


@register("ana04_failure_predictions", sql("SELECT * FROM predictions", PREDICT_CTE))
def ana04_failure_predictions(spark, sf):
    return _predictions(spark, sf)[2].withColumn("feature_importance", F.to_json("feature_importance"))


# ---------------------------------------------------------------- economics
def _econ_sql() -> str:
    md = (1.0 + economics.ANNUAL_DISCOUNT_RATE) ** (1.0 / 12.0) - 1.0
    pc = (economics.POWER_WATTS / 1000.0) * economics.HOURS_PER_MONTH * economics.POWER_COST_PER_KWH \
        * economics.COOLING_PUE
    keep_rev = economics.HOURS_PER_MONTH * economics.REVENUE_PER_GPU_HOUR_FULL
    keep_cost = pc + economics.MAINTENANCE_COST
    rep_net = economics.HOURS_PER_MONTH * economics.REVENUE_PER_GPU_HOUR_INFERENCE * 0.7 - (
        pc + economics.MAINTENANCE_COST * 0.8)

    def resid_case(grade_expr: str, default_expr: str) -> str:
        parts = []
        for model, t in economics.RESIDUAL_BY_MODEL.items():
            inner = " ".join(f"WHEN {grade_expr} = '{g}' THEN {float(v)!r}" for g, v in t.items())
            parts.append(f"WHEN model = '{model}' THEN CASE {inner} END")
        inner = " ".join(f"WHEN {grade_expr} = '{g}' THEN {float(v)!r}" for g, v in economics.RESIDUAL_DEFAULT.items())
        return f"coalesce(CASE {' '.join(parts)} ELSE CASE {inner} END END, {default_expr})"

    fair = resid_case("'fair'", "12000.0")
    by_grade = resid_case("grade", "NULL")
    keep = (f"list_sum(list_transform(range(12), lambda m: (({keep_rev!r} * (util / 100.0) - {keep_cost!r}) "
            f"* greatest(0.2, (h - m * 2) / 100.0) - least(p90, 0.6) * fair / 12.0) "
            f"* (1.0 / pow({1.0 + md!r}, m))))")
    rep = (f"list_sum(list_transform(range(12), lambda m: ({rep_net!r} * greatest(0.3, (h - m) / 100.0) "
           f"- least(p90, 0.6) * fair / 12.0) * (1.0 / pow({1.0 + md!r}, m))))")
    ctes = PREDICT_CTE + "," + HEALTH_CTE + f""",
ectx AS (
  SELECT h.gpu_uuid, coalesce(h.overall_score, 70.0) AS h, coalesce(h.health_grade, 'fair') AS grade,
    coalesce(p.failure_prob_30d, 0.1) AS p30, coalesce(p.failure_prob_90d, 0.2) AS p90,
    CASE WHEN coalesce(u.util, 0.0) <> 0 THEN u.util ELSE 0.5 END AS util, a.model
  FROM health h LEFT JOIN predictions p USING (gpu_uuid) LEFT JOIN gpu_assets a USING (gpu_uuid)
  LEFT JOIN (SELECT gpu_uuid, avg(sm_active) AS util FROM gpu_metrics, as_of
             WHERE time >= as_of - INTERVAL '30 days' AND time <= as_of GROUP BY 1) u USING (gpu_uuid)),
ef AS (SELECT *, {fair} AS fair, {by_grade} AS by_grade FROM ectx),
ev AS (SELECT *, {keep} AS npv_keep, coalesce(by_grade, {resid_case("'fair'", "10000.0")}) * 0.95 AS npv_sell,
         {rep} AS npv_repurpose, coalesce(by_grade, 5000.0) * 0.1 AS salvage_value FROM ef),
er AS (SELECT *, greatest(npv_keep, npv_sell, npv_repurpose, salvage_value) AS top,
         list_sort([npv_keep, npv_sell, npv_repurpose, salvage_value], 'DESC') AS ranked FROM ev),
decisions AS (
  SELECT o.as_of AS time, gpu_uuid,
    CASE WHEN npv_keep = top THEN 'keep' WHEN npv_sell = top THEN 'sell' WHEN npv_repurpose = top THEN 'repurpose'
         ELSE 'decommission' END AS decision,
    {r('npv_keep', 2)} AS npv_keep, {r('npv_sell', 2)} AS npv_sell, {r('npv_repurpose', 2)} AS npv_repurpose,
    {r('salvage_value', 2)} AS salvage_value, {r('top', 2)} AS expected_value,
    {r('CASE WHEN ranked[1] > 0 THEN least(0.95, 0.5 + (ranked[1] - ranked[2]) / ranked[1] * 0.5) ELSE 0.5 END', 2)}
      AS confidence,
    h AS health_score, p30 AS failure_prob_30d, util AS utilization, o.as_of AS analyzed_at,
    printf('%.1f', {r('h', 1)}) AS h1, printf('%.1f', {r('p30 * 100.0', 1)}) || '%' AS p1,
    printf('%.0f', {r('npv_keep', 0)}) AS k0, printf('%.0f', {r('npv_sell', 0)}) AS s0
  FROM er, as_of o),
rationales AS (
  SELECT * EXCLUDE (h1, p1, k0, s0), CASE decision
    WHEN 'keep' THEN 'Recommended to KEEP: Health score ' || h1 || '/100 is good, failure risk ' || p1
      || ' is acceptable, NPV of continued operation ($' || k0 || ') exceeds resale value ($' || s0 || ').'
    WHEN 'sell' THEN 'Recommended to SELL: Current market value ($' || s0 || ') exceeds future operating value ($' || k0
      || '). Health score ' || h1 || '/100, failure risk ' || p1 || '.'
    WHEN 'repurpose' THEN 'Recommended to REPURPOSE: Health score ' || h1
      || '/100 too low for training, but suitable for inference workloads. Failure risk ' || p1 || '.'
    ELSE 'Recommended to DECOMMISSION: Health score ' || h1 || '/100 critical, failure risk ' || p1
      || ' too high. Salvage for parts.' END AS rationale
  FROM decisions)"""
    return ctes


ECON_CTES = _econ_sql()


def _score_history(spark, sf):
    """Two weekly scoring runs."""
    m = load_fleet(spark, sf)["metrics"]
    return health.score_history(m, as_of_col(m), 2, 7, LB, P["active"], P["gap_seconds"], P["sample_seconds"], bucket="1 day")


def _decisions(spark, sf, scores=None):
    """Decisions from a score history of two weekly runs: devices that only the older
    run scored are present in it and get no decision."""
    t = load_fleet(spark, sf)
    m = t["metrics"]
    a = as_of_col(m)
    h = _score_history(spark, sf) if scores is None else scores
    _, _, p = _predictions(spark, sf)
    return t, economics.economic_decisions(h, p, t["assets"], m, a, "30 days", P["active"])


@register("ana05_economic_decisions", sql(rnd("SELECT * FROM rationales", ["utilization"]), ECON_CTES))
def ana05_economic_decisions(spark, sf):
    return finish(_decisions(spark, sf)[1])


@register("prj22_decision_rationale", sql("SELECT gpu_uuid, decision, rationale FROM rationales", ECON_CTES))
def prj22_decision_rationale(spark, sf):
    return _decisions(spark, sf)[1].select("gpu_uuid", "decision", "rationale")


# ---------------------------------------------------------------- alerts
ALERT_LIST = """
SELECT h.gpu_uuid, a.model, a.hostname, h.overall_score, h.health_grade, h.degradation_factors, h.time AS scored_at
FROM health h LEFT JOIN gpu_assets a ON h.gpu_uuid = a.gpu_uuid WHERE h.overall_score < {threshold}
ORDER BY h.overall_score, h.gpu_uuid"""


@register("ana06_low_health_alerts", sql(ALERT_LIST.format(threshold=70), HEALTH_CTE))
def ana06_low_health_alerts(spark, sf):
    """The alert list (ANA6, TOP3): every device below 70, worst first."""
    t, a, h = _health(spark, sf)
    return _as_json(alerts.low_health(h, t["assets"], a, threshold=70.0))


@register("jon02_scores_below_85_with_assets", sql(ALERT_LIST.format(threshold=85), HEALTH_CTE))
def jon02_scores_below_85_with_assets(spark, sf):
    """The same list with a higher threshold, which healthy fleets reach too (JON2)."""
    t, a, h = _health(spark, sf)
    return _as_json(alerts.low_health(h, t["assets"], a, threshold=85.0))


@register("top06_lowest_20_scores", sql("""
SELECT gpu_uuid, overall_score, health_grade FROM health ORDER BY overall_score ASC, gpu_uuid LIMIT 20""",
                                        HEALTH_CTE))
def top06_lowest_20_scores(spark, sf):
    """The 20 lowest scores: the limit is the report's feature."""
    t, a, h = _health(spark, sf)
    return h.select("gpu_uuid", "overall_score", "health_grade").orderBy("overall_score", "gpu_uuid").limit(20)


@register("flt06_unacknowledged_by_severity", sql(rnd("""
SELECT gpu_uuid, anomaly_type, value, z_score, severity, time FROM anomalies
WHERE severity = 'medium' ORDER BY time DESC, gpu_uuid, anomaly_type LIMIT 10""", ["value"]), ANOMALY_CTE))
def flt06_unacknowledged_by_severity(spark, sf):
    """The newest ten unacknowledged anomalies of a severity; the data hold few high ones."""
    m, a, an = _anoms(spark, sf)
    return finish(anomaly.unacknowledged_high(an, a, "10 minutes", 10, severity="medium"))


# ---------------------------------------------------------------- score history
def _health_run(k: int) -> str:
    """HEALTH_CTE of the run ``k`` weeks earlier, active within a week, under names of its own."""
    text = HEALTH_CTE.replace(f"INTERVAL '{P['active']}' AND time <= as_of", "INTERVAL '7 days' AND time <= as_of")
    text = re.sub(r"\bas_of (a|o)\b", rf"as_of_{k} \1", text)
    text = text.replace("gpu_metrics, as_of\n", f"gpu_metrics, as_of_{k}\n")
    for name in ("hw", "hact", "hg", "hr", "hht", "hs", "hd", "health"):
        text = re.sub(rf"\b{name}\b(?!_)", f"{name}_{k}", text)
    return f"as_of_{k} AS (SELECT as_of - INTERVAL '{7 * k} days' AS as_of FROM as_of),{text}"


HISTORY_CTES = ",\n".join(_health_run(k) for k in range(4)) + ",\nhistory AS (" + " UNION ALL ".join(
    f"SELECT time, gpu_uuid, overall_score FROM health_{k}" for k in range(4)) + ")"


@register("jon14_weekly_score_deltas", sql(rnd("""
SELECT time, gpu_uuid, overall_score,
  overall_score - last_value(overall_score) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAY PRECEDING) AS score_delta_7d,
  overall_score - last_value(overall_score) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 30 DAY PRECEDING) AS score_delta_30d,
  CASE WHEN count(*) OVER (w RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) > 1 THEN
    regr_slope(overall_score, epoch(time) / 86400.0) OVER (w RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) END AS degradation_rate
FROM history WINDOW w AS (PARTITION BY gpu_uuid ORDER BY time)""",
    ["overall_score", "score_delta_7d", "score_delta_30d", "degradation_rate"]), HISTORY_CTES))
def jon14_weekly_score_deltas(spark, sf):
    """Four weekly scoring runs from one pass, then deltas and rate per device."""
    m = load_fleet(spark, sf)["metrics"]
    h = health.score_history(m, as_of_col(m), 4, 7, LB, "7 days", P["gap_seconds"], P["sample_seconds"], bucket="1 day")
    return finish(health.score_deltas(h.select("time", "gpu_uuid", "overall_score")))

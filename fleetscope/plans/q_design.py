"""Registered design-tier queries ([D] rows of the inventory) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions.timewin import as_of_col
from fleetscope.operators import design, fleet, rollups
from fleetscope.plans.catalog import DRIVER_PARAMS as P
from fleetscope.plans.catalog import finish, register, rnd
from fleetscope.plans.oracle import sql
from fleetscope.plans.q_analytics import HEALTH_CTE, _health
from fleetscope.sources.driver import load_fleet

DAY = 86400


def _m(spark, sf):
    return load_fleet(spark, sf)["metrics"]


@register("win10_moving_average_3", sql(rnd("""
SELECT gpu_uuid, time, rn - 1 AS row_index, ma AS moving_avg FROM (
  SELECT gpu_uuid, time, row_number() OVER w AS rn,
         (gpu_temp + lag(gpu_temp, 1) OVER w + lag(gpu_temp, 2) OVER w) / 3.0 AS ma
  FROM gpu_metrics WINDOW w AS (PARTITION BY gpu_uuid ORDER BY time)) WHERE rn >= 3""", ["moving_avg"])))
def win10_moving_average_3(spark, sf):
    return finish(design.moving_average(_m(spark, sf), "gpu_temp", 3))


@register("win12_savgol_5", sql(rnd("""
SELECT gpu_uuid, time, row_number() OVER w - 1 AS row_index,
  (lag(gpu_temp, 2) OVER w * -3.0 + lag(gpu_temp, 1) OVER w * 12.0 + gpu_temp * 17.0
   + lead(gpu_temp, 1) OVER w * 12.0 + lead(gpu_temp, 2) OVER w * -3.0) / 35.0 AS smoothed
FROM gpu_metrics WINDOW w AS (PARTITION BY gpu_uuid ORDER BY time)""", ["smoothed"])))
def win12_savgol_5(spark, sf):
    return finish(design.savgol5(_m(spark, sf), "gpu_temp"))


@register("win08_rolling_day_stats", sql(rnd("""
SELECT gpu_uuid, time, gpu_temp, avg(gpu_temp) OVER w AS roll_mean, stddev_samp(gpu_temp) OVER w AS roll_std,
  max(gpu_temp) OVER w AS roll_max, min(gpu_temp) OVER w AS roll_min, count(gpu_temp) OVER w AS roll_n
FROM gpu_metrics
WINDOW w AS (PARTITION BY gpu_uuid ORDER BY time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""",
                                                 ["gpu_temp", "roll_mean", "roll_std", "roll_max", "roll_min"])))
def win08_rolling_day_stats(spark, sf):
    return finish(design.rolling_stats(_m(spark, sf), "gpu_temp", DAY))


@register("win06_hourly_temp_spikes", sql(rnd("""
SELECT gpu_uuid, time, gpu_temp_avg, prev, gpu_temp_avg - prev AS delta FROM (
  SELECT gpu_uuid, time, gpu_temp_avg, lag(gpu_temp_avg) OVER (PARTITION BY gpu_uuid ORDER BY time) AS prev
  FROM (SELECT gpu_uuid, time_bucket(INTERVAL '1 hour', time) AS time, avg(gpu_temp) AS gpu_temp_avg
        FROM gpu_metrics GROUP BY 1, 2)) WHERE gpu_temp_avg - prev > 15.0""", ["gpu_temp_avg", "prev", "delta"])))
def win06_hourly_temp_spikes(spark, sf):
    r = rollups.rollup(_m(spark, sf), "1 hour", True, keys=("gpu_uuid",))
    return finish(design.bucket_spikes(r, "gpu_temp_avg", 15.0))


@register("win07_largest_gaps", sql(rnd("""
SELECT gpu_uuid, time, next_time, (epoch_us(next_time) - epoch_us(time)) / 1e6 AS gap_seconds FROM (
  SELECT gpu_uuid, time, lead(time) OVER (PARTITION BY gpu_uuid ORDER BY time) AS next_time FROM gpu_metrics)
ORDER BY gap_seconds DESC NULLS LAST, gpu_uuid, time LIMIT 10""", ["gap_seconds"])))
def win07_largest_gaps(spark, sf):
    return finish(design.largest_gaps(_m(spark, sf), 10))


@register("win11_interpolated_daily_grid", sql(rnd("""
WITH r AS (SELECT gpu_uuid, time_bucket(INTERVAL '1 day', time) AS time, avg(gpu_temp) AS value
           FROM gpu_metrics GROUP BY 1, 2),
 span AS (SELECT gpu_uuid, min(time) AS lo, max(time) AS hi FROM r GROUP BY 1),
 grid AS (SELECT gpu_uuid, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS time FROM span),
 g AS (SELECT grid.gpu_uuid, grid.time, r.value, epoch(grid.time) AS s,
         CASE WHEN r.value IS NOT NULL THEN epoch(grid.time) END AS vs
       FROM grid LEFT JOIN r ON grid.gpu_uuid = r.gpu_uuid AND grid.time = r.time),
 f AS (SELECT *,
   last_value(value IGNORE NULLS) OVER (PARTITION BY gpu_uuid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
   last_value(vs IGNORE NULLS) OVER (PARTITION BY gpu_uuid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ps,
   first_value(value IGNORE NULLS) OVER (PARTITION BY gpu_uuid ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
   first_value(vs IGNORE NULLS) OVER (PARTITION BY gpu_uuid ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ns
   FROM g)
SELECT gpu_uuid, time,
  coalesce(value, pv + (nv - pv) * coalesce(CASE WHEN ns - ps <> 0 THEN (s - ps) / (ns - ps) END, 0.0)) AS value,
  value IS NULL AS interpolated
FROM f""", ["value"])))
def win11_interpolated_daily_grid(spark, sf):
    return finish(design.interpolate_grid(_m(spark, sf), "gpu_temp", DAY))


@register("ana10_risk_scores", sql(f"""
WITH g AS (SELECT gpu_uuid, max(ecc_sbe_aggregate) - min(ecc_sbe_aggregate) AS ecc_correctable_7d,
    max(ecc_dbe_aggregate) - min(ecc_dbe_aggregate) AS ecc_uncorrectable_7d, max(gpu_temp) AS temp_max_7d,
    CAST(count_if(throttle_reasons > 0) AS BIGINT) AS throttle_events_7d, stddev_samp(power_usage) AS power_std_7d
  FROM gpu_metrics, as_of WHERE time > as_of - INTERVAL '{P['baseline']}' AND time <= as_of GROUP BY 1),
 s AS (SELECT *, CAST(round(CAST(greatest(0.0, least(100.0,
    greatest(0.0, least(100.0, ecc_correctable_7d / 50.0 * 100.0)) * 0.4
    + CASE WHEN ecc_uncorrectable_7d > 0 THEN 30.0 ELSE 0.0 END
    + greatest(0.0, least(100.0, (temp_max_7d - 75.0) / 20.0 * 100.0)) * 0.3
    + greatest(0.0, least(100.0, throttle_events_7d / 10.0 * 100.0)) * 0.2
    + greatest(0.0, least(100.0, coalesce(power_std_7d, 0.0) / 50.0 * 100.0)) * 0.1)) AS DECIMAL(38,12)), 0)
    AS INTEGER) AS risk_score FROM g)
SELECT gpu_uuid, ecc_correctable_7d, ecc_uncorrectable_7d, round(temp_max_7d, 6) AS temp_max_7d,
  throttle_events_7d, round(power_std_7d, 6) AS power_std_7d, risk_score,
  CASE WHEN risk_score > 0 AND risk_score <= 25 THEN 'low' WHEN risk_score > 25 AND risk_score <= 50 THEN 'medium'
       WHEN risk_score > 50 AND risk_score <= 75 THEN 'high' WHEN risk_score > 75 AND risk_score <= 100 THEN 'critical'
  END AS risk_level
FROM s"""))
def ana10_risk_scores(spark, sf):
    m = _m(spark, sf)
    return finish(design.risk_score(m, as_of_col(m), P["baseline"]))


@register("agg34_grade_distribution", sql("SELECT health_grade, count(*) AS devices FROM health GROUP BY 1",
                                          HEALTH_CTE))
def agg34_grade_distribution(spark, sf):
    return design.grade_distribution(_health(spark, sf)[2])


@register("agg33_throttle_leaderboard", sql(f"""
SELECT gpu_uuid, CAST(count_if(throttle_reasons > 0) AS BIGINT) AS throttle_events, count(*) AS samples,
  min(time) AS first_sample, max(time) AS last_sample
FROM gpu_metrics, as_of WHERE time > as_of - INTERVAL '{P['baseline']}'
GROUP BY 1 ORDER BY throttle_events DESC, gpu_uuid"""))
def agg33_throttle_leaderboard(spark, sf):
    m = _m(spark, sf)
    return design.throttle_leaderboard(m, as_of_col(m), P["baseline"])


@register("agg35_successive_change", sql(rnd("""
SELECT gpu_uuid,
  CASE WHEN (max(epoch_us(time)) - min(epoch_us(time))) = 0 THEN NULL
       ELSE CAST(arg_max(ecc_sbe_aggregate, time) - arg_min(ecc_sbe_aggregate, time) AS DOUBLE)
            / ((max(epoch_us(time)) - min(epoch_us(time))) / 8.64e10) END AS rate_per_day,
  avg(d) AS mean_successive_diff
FROM (SELECT *, ecc_sbe_aggregate - lag(ecc_sbe_aggregate) OVER (PARTITION BY gpu_uuid ORDER BY time) AS d
      FROM gpu_metrics) GROUP BY 1""", ["rate_per_day", "mean_successive_diff"])))
def agg35_successive_change(spark, sf):
    return finish(design.successive_change(_m(spark, sf)))


@register("agg36_power_util_corr", sql(rnd("""
SELECT gpu_uuid, CASE WHEN count(*) < 2 OR stddev_pop(power_usage) = 0 OR stddev_pop(sm_active) = 0 THEN NULL
                      ELSE corr(power_usage, sm_active) END AS power_util_corr,
  quantile_disc(gpu_temp, 0.5) AS temp_p50, quantile_disc(gpu_temp, 0.95) AS temp_p95, quantile_disc(gpu_temp, 0.99) AS temp_p99
FROM gpu_metrics GROUP BY 1""", ["power_util_corr", "temp_p50", "temp_p95", "temp_p99"])))
def agg36_power_util_corr(spark, sf):
    q = F.col("temp_p50_p95_p99")
    d = design.power_util_profile(_m(spark, sf)).select("gpu_uuid", "power_util_corr", q[0].alias("temp_p50"), q[1].alias("temp_p95"),
                                                        q[2].alias("temp_p99"))
    return finish(d.withColumn("power_util_corr", F.when(~F.isnan("power_util_corr"), F.col("power_util_corr"))))


@register("agg37_fleet_recent", sql(rnd(f"""
SELECT count(DISTINCT gpu_uuid) AS gpus, avg(gpu_temp) AS avg_temp, max(gpu_temp) AS max_temp,
  sum(power_usage) / 1000.0 AS total_kw, count(*) AS samples
FROM gpu_metrics, as_of WHERE time > as_of - INTERVAL '{P['recent']}'""", ["avg_temp", "max_temp", "total_kw"])))
def agg37_fleet_recent(spark, sf):
    m = _m(spark, sf)
    return finish(design.fleet_recent(m, as_of_col(m), P["recent"]))


@register("jon15_model_averages", sql(rnd("""
WITH l AS (SELECT DISTINCT ON (gpu_uuid) gpu_uuid, time, gpu_temp FROM gpu_metrics ORDER BY gpu_uuid, time DESC),
 j AS (SELECT l.*, a.model FROM l LEFT JOIN gpu_assets a ON l.gpu_uuid = a.gpu_uuid),
 m AS (SELECT model, avg(gpu_temp) AS model_avg, count(*) AS model_devices FROM j GROUP BY 1)
SELECT j.gpu_uuid, j.time, j.gpu_temp, j.model, m.model_avg, m.model_devices, j.gpu_temp - m.model_avg AS delta_vs_model
FROM j LEFT JOIN m ON j.model IS NOT DISTINCT FROM m.model""", ["gpu_temp", "model_avg", "delta_vs_model"])))
def jon15_model_averages(spark, sf):
    t = load_fleet(spark, sf)
    last = fleet.latest_metrics(t["metrics"], ["time", "gpu_temp"])
    return finish(design.with_model_averages(last, t["assets"], "gpu_temp"))

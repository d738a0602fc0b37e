"""Registered queries for the remaining inventory rows: freshness (AGG26, SET3),
bucket summaries (AGG27-AGG31, FLT9), predicates (FLT5), top lists (TOP4, WIN9),
windows (WIN13, WIN14), quality flags (VAL8), alert records (STR10) and feature
scaling (PRJ28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions.timewin import as_of_col
from fleetscope.operators import alerts, design, latest, rollups, validate
from fleetscope.plans.catalog import DRIVER_PARAMS as P
from fleetscope.plans.catalog import finish, register, rnd
from fleetscope.plans.oracle import sql
from fleetscope.plans.q_analytics import FEATURE_CTE, HEALTH_CTE, PREDICT_CTE, _features, _health, _predictions
from fleetscope.plans.q_market import _pages
from fleetscope.sources.driver import load_fleet

DAY = 86400


def _m(spark, sf):
    return load_fleet(spark, sf)["metrics"]


@register("agg26_table_freshness", sql(rnd("""
WITH t AS (
  SELECT 'gpu_metrics' AS table_name, count(*) AS row_count, max(time) AS latest FROM gpu_metrics
  UNION ALL SELECT 'gpu_assets', count(*), max(CAST(deployment_date AS TIMESTAMP)) FROM gpu_assets
  UNION ALL SELECT 'market_pages', count(*), max(TIMESTAMP '2024-01-31 00:00:00' + to_minutes(CAST(p_partkey AS INTEGER)))
            FROM part)
SELECT t.*, (epoch_us(o.as_of) - epoch_us(t.latest)) / 1e6 AS freshness_seconds FROM t, as_of o""",
                                               ["freshness_seconds"])))
def agg26_table_freshness(spark, sf):
    t = load_fleet(spark, sf)
    m = t["metrics"]
    a = as_of_col(m)
    parts = [m.agg(F.lit("gpu_metrics").alias("table_name"), F.count(F.lit(1)).alias("row_count"),
                   F.max("time").alias("latest")),
             t["assets"].agg(F.lit("gpu_assets").alias("table_name"), F.count(F.lit(1)).alias("row_count"),
                             F.max(F.col("deployment_date").cast("timestamp")).alias("latest")),
             _pages(spark, sf).agg(F.lit("market_pages").alias("table_name"), F.count(F.lit(1)).alias("row_count"),
                                   F.max("fetched_at").alias("latest"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return finish(u.withColumn("freshness_seconds", (F.unix_micros(a) - F.unix_micros("latest")) / 1e6))


@register("agg27_temp_trend_5min", sql(rnd("""
SELECT gpu_uuid, time_bucket(INTERVAL '5 minutes', time) AS time, avg(gpu_temp) AS avg_temp,
  max(gpu_temp) AS max_temp, min(gpu_temp) AS min_temp, stddev_samp(gpu_temp) AS stddev_temp, count(*) AS sample_count
FROM gpu_metrics GROUP BY 1, 2""", ["avg_temp", "max_temp", "min_temp", "stddev_temp"])))
def agg27_temp_trend_5min(spark, sf):
    return finish(rollups.temperature_trend(_m(spark, sf), "5 minutes"))


@register("agg28_ecc_delta_hourly", sql("""
SELECT gpu_uuid, time_bucket(INTERVAL '1 hour', time) AS time,
  max(ecc_sbe_aggregate) - min(ecc_sbe_aggregate) AS sbe_delta, max(ecc_dbe_aggregate) - min(ecc_dbe_aggregate) AS dbe_delta
FROM gpu_metrics GROUP BY 1, 2
HAVING max(ecc_sbe_aggregate) - min(ecc_sbe_aggregate) > 0 OR max(ecc_dbe_aggregate) - min(ecc_dbe_aggregate) > 0"""))
def agg28_ecc_delta_hourly(spark, sf):
    return rollups.ecc_per_bucket(_m(spark, sf), "1 hour", 0)


@register("agg29_util_per_watt_15min", sql(rnd("""
SELECT gpu_uuid, time_bucket(INTERVAL '15 minutes', time) AS time, avg(sm_active) AS avg_util,
  avg(power_usage) AS avg_power, avg(sm_active) / nullif(avg(power_usage), 0) AS util_per_watt
FROM gpu_metrics GROUP BY 1, 2""", ["avg_util", "avg_power", "util_per_watt"])))
def agg29_util_per_watt_15min(spark, sf):
    return finish(rollups.utilization_per_watt(_m(spark, sf), "15 minutes"))


@register("agg30_fleet_p95_hourly", sql(rnd("""
SELECT time_bucket(INTERVAL '1 hour', time) AS time, count(DISTINCT gpu_uuid) AS gpu_count,
  quantile_cont(gpu_temp, 0.95) AS p95_temp, avg(gpu_temp) AS avg_temp, sum(power_usage) AS total_power,
  count(*) AS event_count
FROM gpu_metrics GROUP BY 1""", ["p95_temp", "avg_temp", "total_power"])))
def agg30_fleet_p95_hourly(spark, sf):
    return finish(rollups.fleet_buckets(_m(spark, sf), "1 hour", exact=True))


@register("agg31_rollup_15min", sql(rnd("""
SELECT time_bucket(INTERVAL '15 minutes', time) AS time, gpu_uuid, avg(gpu_temp) AS gpu_temp_avg,
  stddev_samp(gpu_temp) AS gpu_temp_stddev, max(gpu_temp) AS gpu_temp_max, avg(power_usage) AS power_usage_avg,
  max(ecc_sbe_aggregate) - min(ecc_sbe_aggregate) AS ecc_sbe_delta, count(*) AS sample_count
FROM gpu_metrics GROUP BY 1, 2""", ["gpu_temp_avg", "gpu_temp_stddev", "gpu_temp_max", "power_usage_avg"])))
def agg31_rollup_15min(spark, sf):
    return finish(rollups.rollup_15min(_m(spark, sf)))


@register("flt05_throttle_or_dbe_rows", sql("""
SELECT time, gpu_uuid, throttle_reasons, ecc_dbe_volatile FROM gpu_metrics
WHERE throttle_reasons > 0 OR ecc_dbe_volatile > 0"""))
def flt05_throttle_or_dbe_rows(spark, sf):
    return _m(spark, sf).where((F.col("throttle_reasons") > 0) | (F.col("ecc_dbe_volatile") > 0)) \
                        .select("time", "gpu_uuid", "throttle_reasons", "ecc_dbe_volatile")


@register("top04_recent_critical_health", sql("""
SELECT * FROM health, as_of o WHERE time >= o.as_of - INTERVAL '30 minutes' AND overall_score < 85
ORDER BY time DESC, gpu_uuid LIMIT 10""".replace("SELECT *", "SELECT health.*"), HEALTH_CTE))
def top04_recent_critical_health(spark, sf):
    t, a, h = _health(spark, sf)
    return alerts.recent_critical_health(h, a, "30 minutes", 85.0, 10) \
                 .withColumn("degradation_factors", F.to_json("degradation_factors"))


@register("win09_latest_1008_per_gpu", sql(rnd("""
SELECT gpu_uuid, time, gpu_temp, CAST(recency_rank AS INTEGER) AS recency_rank FROM (
  SELECT gpu_uuid, time, gpu_temp, row_number() OVER (PARTITION BY gpu_uuid ORDER BY time DESC) AS recency_rank
  FROM gpu_metrics) WHERE recency_rank <= 1008""", ["gpu_temp"])))
def win09_latest_1008_per_gpu(spark, sf):
    m = _m(spark, sf).select("gpu_uuid", "time", "gpu_temp")
    return finish(latest.latest_n_per_key(m, 7 * 24 * 6))


@register("win13_sustained_high_temp", sql(rnd("""
SELECT * FROM (
  SELECT gpu_uuid, time, gpu_temp, avg(gpu_temp) OVER w AS roll_mean, stddev_samp(gpu_temp) OVER w AS roll_std,
    max(gpu_temp) OVER w AS roll_max, min(gpu_temp) OVER w AS roll_min, count(gpu_temp) OVER w AS roll_n
  FROM gpu_metrics
  WINDOW w AS (PARTITION BY gpu_uuid ORDER BY time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))
WHERE roll_mean > 85.0""", ["gpu_temp", "roll_mean", "roll_std", "roll_max", "roll_min"])))
def win13_sustained_high_temp(spark, sf):
    return finish(design.sustained_condition(_m(spark, sf), "gpu_temp", 85.0, DAY))


@register("win14_resample_hourly", sql(rnd("""
SELECT gpu_uuid, time_bucket(INTERVAL '1 hour', time) AS time, avg(gpu_temp) AS value FROM gpu_metrics GROUP BY 1, 2""",
                                           ["value"])))
def win14_resample_hourly(spark, sf):
    return finish(design.resample(_m(spark, sf), "gpu_temp", "1 hour"))


@register("val08_quality_flags", sql("""
SELECT time, gpu_uuid, to_json(list_filter([
    CASE WHEN (epoch_us(o.as_of) - epoch_us(time)) / 1e6 > 3600 THEN 'late' END,
    CASE WHEN NOT (gpu_temp BETWEEN 0 AND 120) OR NOT (power_usage BETWEEN 0 AND 800) THEN 'out_of_range' END],
    lambda x: x IS NOT NULL))::VARCHAR AS quality_flags
FROM gpu_metrics, as_of o"""))
def val08_quality_flags(spark, sf):
    m = _m(spark, sf)
    q = validate.quality_flags(m, as_of_col(m))
    return q.select("time", "gpu_uuid", F.to_json("quality_flags").alias("quality_flags"))


@register("str10_alert_events", sql(rnd("""
SELECT time AS alert_time, gpu_uuid,
  CASE WHEN failure_prob_7d > 0.80 AND confidence > 0.85 THEN 'CRITICAL'
       WHEN failure_prob_30d > 0.70 AND confidence > 0.80 THEN 'HIGH'
       WHEN failure_prob_90d > 0.50 AND confidence > 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  CASE WHEN failure_prob_7d > 0.80 AND confidence > 0.85 THEN 'Remove from production immediately'
       WHEN failure_prob_30d > 0.70 AND confidence > 0.80 THEN 'Schedule replacement within 7 days'
       WHEN failure_prob_90d > 0.50 AND confidence > 0.75 THEN 'Schedule replacement within 30 days'
       ELSE 'Add to watchlist, monitor trends' END AS action,
  failure_prob_7d, failure_prob_30d, failure_prob_90d, predicted_failure_type, estimated_ttf_days, confidence
FROM predictions
WHERE (failure_prob_7d > 0.80 AND confidence > 0.85) OR (failure_prob_30d > 0.70 AND confidence > 0.80)
   OR (failure_prob_90d > 0.50 AND confidence > 0.75) OR failure_prob_90d > 0.30""", ["confidence"]), PREDICT_CTE))
def str10_alert_events(spark, sf):
    return finish(alerts.alert_events(_predictions(spark, sf)[2]))


SCALED = ["gpu_temp_mean", "power_usage_mean", "sm_active_mean"]


@register("prj28_scaled_features", sql(rnd("SELECT gpu_uuid, " + ", ".join(
    f"({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) AS {c}_minmax, "
    f"({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0) AS {c}_z" for c in SCALED) + " FROM features",
    [f"{c}_{s}" for c in SCALED for s in ("minmax", "z")]), FEATURE_CTE))
def prj28_scaled_features(spark, sf):
    """Fleet-wide min-max and standard scaling; the column statistics are lazy
    scalar subqueries (one small aggregation), not a window over all rows."""
    f = _features(spark, sf)[2]
    stats = f.agg(*[x for c in SCALED for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"),
                                               F.avg(c).alias(f"{c}_mu"), F.stddev_samp(c).alias(f"{c}_sd"))])
    out = [F.col("gpu_uuid")]
    for c in SCALED:
        lo, hi = stats.select(f"{c}_lo").scalar(), stats.select(f"{c}_hi").scalar()
        mu, sd = stats.select(f"{c}_mu").scalar(), stats.select(f"{c}_sd").scalar()
        out.append(F.try_divide(F.col(c) - lo, F.nullif(hi - lo, F.lit(0.0))).alias(f"{c}_minmax"))
        out.append(F.try_divide(F.col(c) - mu, F.nullif(sd, F.lit(0.0))).alias(f"{c}_z"))
    return finish(f.select(*out))


@register("prj11_asset_profiles", sql(rnd("""
SELECT a.gpu_uuid, json_extract_string(a.tags, '$.profile') AS profile, a.model,
  CAST(floor((epoch_us(o.as_of) - epoch_us(CAST(a.deployment_date AS TIMESTAMP))) / 1e6 / 86400.0) AS INTEGER)
    AS age_days,
  epoch_us(CAST(a.deployment_date AS TIMESTAMP)) / 1e6 AS deployed_epoch
FROM gpu_assets a, as_of o""", ["deployed_epoch"])))
def prj11_asset_profiles(spark, sf):
    from fleetscope.functions.columns import days_floor, epoch_seconds, json_text_field
    t = load_fleet(spark, sf)
    a = as_of_col(t["metrics"])
    return finish(t["assets"].select("gpu_uuid", json_text_field("tags", "profile").alias("profile"), "model",
                                     days_floor(a, F.col("deployment_date")).alias("age_days"),
                                     epoch_seconds("deployment_date").alias("deployed_epoch")))


# ANA11 backtest: predictions made BACKTEST_DAYS before as_of, scored against the
# first uncorrectable-ECC event of each device within the 30-day horizon.
BACKTEST_DAYS = 15
_BT = f"bt AS (SELECT as_of - INTERVAL '{BACKTEST_DAYS} days' AS as_of FROM as_of),"
BT_PREDICT_CTE = _BT + PREDICT_CTE.replace("FROM gpu_metrics m, as_of a WHERE", "FROM gpu_metrics m, bt a WHERE") \
                                  .replace("LEFT JOIN gpu_assets a USING (gpu_uuid), as_of x)",
                                           "LEFT JOIN gpu_assets a USING (gpu_uuid), bt x)")


@register("ana11_outcome_backtest", sql("""
WITH fails AS (SELECT gpu_uuid, CAST(min(time) AS DATE) AS failure_date FROM gpu_metrics
               WHERE ecc_dbe_volatile > 0 GROUP BY 1),
 per AS (SELECT p.gpu_uuid, p.time, p.failure_prob_30d,
           max(CAST(CAST(f.failure_date AS TIMESTAMP) > p.time
                    AND CAST(f.failure_date AS TIMESTAMP) <= p.time + INTERVAL 30 DAY AS INTEGER)) AS failed
         FROM predictions p LEFT JOIN fails f ON p.gpu_uuid = f.gpu_uuid GROUP BY 1, 2, 3),
 lab AS (SELECT *, CAST(failure_prob_30d >= 0.5 AS INTEGER) AS predicted FROM per)
SELECT date_trunc('month', time) AS month,
  CAST(sum(CAST(predicted = 1 AND failed = 1 AS INTEGER)) AS BIGINT) AS tp,
  CAST(sum(CAST(predicted = 1 AND coalesce(failed, 0) = 0 AS INTEGER)) AS BIGINT) AS fp,
  CAST(sum(CAST(predicted = 0 AND failed = 1 AS INTEGER)) AS BIGINT) AS fn,
  CAST(sum(CAST(predicted = 0 AND coalesce(failed, 0) = 0 AS INTEGER)) AS BIGINT) AS tn
FROM lab GROUP BY 1""", BT_PREDICT_CTE))
def ana11_outcome_backtest(spark, sf):
    from fleetscope.operators import features, predict
    t = load_fleet(spark, sf)
    m = t["metrics"]
    bt = as_of_col(m) - F.make_interval(days=F.lit(BACKTEST_DAYS))
    f = features.gpu_features(m, t["assets"], bt, f"{P['lookback_days']} days", trend_bucket="1 day", stamp_last=True)
    preds = predict.predict_failures(f, bt, active=P["active"])
    fails = m.where(F.col("ecc_dbe_volatile") > 0).groupBy("gpu_uuid") \
             .agg(F.to_date(F.min("time")).alias("failure_date"))
    return design.outcome_confusion(preds, fails, 30, 0.5)


@register("snk10_rollup_refresh_5min", sql(rnd("""
WITH b AS (SELECT as_of - INTERVAL '30 days' AS lo, as_of - INTERVAL '30 seconds' AS hi FROM as_of)
SELECT time_bucket(INTERVAL '5 minutes', m.time) AS time, m.gpu_uuid, m.hostname,
  avg(gpu_temp) AS gpu_temp_avg, max(gpu_temp) AS gpu_temp_max, min(gpu_temp) AS gpu_temp_min,
  avg(memory_temp) AS memory_temp_avg, max(memory_temp) AS memory_temp_max,
  avg(power_usage) AS power_usage_avg, max(power_usage) AS power_usage_max, min(power_usage) AS power_usage_min,
  avg(sm_active) AS sm_active_avg, max(sm_active) AS sm_active_max,
  avg(memory_utilization) AS memory_util_avg, max(memory_utilization) AS memory_util_max,
  CAST(sum(ecc_sbe_volatile) AS BIGINT) AS ecc_sbe_count, CAST(sum(ecc_dbe_volatile) AS BIGINT) AS ecc_dbe_count,
  count(*) AS sample_count, CAST(time_bucket(INTERVAL '5 minutes', m.time) AS DATE) AS date
FROM gpu_metrics m, b
WHERE m.time >= CAST(CAST(b.lo AS DATE) AS TIMESTAMP) AND m.time < b.hi
GROUP BY 1, 2, 3, b.hi
HAVING time_bucket(INTERVAL '5 minutes', m.time) + INTERVAL 5 MINUTE <= b.hi""",
    ["gpu_temp_avg", "gpu_temp_max", "gpu_temp_min", "memory_temp_avg", "memory_temp_max", "power_usage_avg",
     "power_usage_max", "power_usage_min", "sm_active_avg", "sm_active_max", "memory_util_avg", "memory_util_max"])))
def snk10_rollup_refresh_5min(spark, sf):
    """Rows a 5-minute refresh policy (start 30 days, end 30 seconds) recomputes at ``as_of``."""
    from fleetscope.operators import tables as tb
    m = _m(spark, sf)
    return finish(tb.refresh_frame(m, "5min", as_of_col(m), "30 days", "30 seconds"))

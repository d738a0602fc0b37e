"""Registered queries of operators that the other modules leave out: score forecast
(ANA7), panels and chosen devices (SET6, FLT2, FLT3, FLT11), joins (JON12, JON13), small
projections (PRJ20, PRJ23-PRJ25, PRJ27), sketches and further rollups (AGG32-AGG34,
AGG36-AGG38), other window widths (WIN8), training rows (TOP5, SET5), top lists (TOP6)
and whole events (PRJ3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions.columns import live_status
from fleetscope.functions.timewin import as_of_col, between_times
from fleetscope.operators import design, features, fleet, forecast, health, ingest, latest, predict, rollups
from fleetscope.plans.catalog import DRIVER_PARAMS as P
from fleetscope.plans.catalog import finish, register, rnd
from fleetscope.plans.oracle import sql
from fleetscope.plans.q_analytics import (ECON_CTES, FEATURE_CTE, HEALTH_CTE, HISTORY_CTES, LB, PREDICT_CTE, _decisions, _features,
                                          _health, _predictions)
from fleetscope.sources.driver import device_model, load_fleet

HOUR, DAY = 3600, 86400


def _m(spark, sf):
    return load_fleet(spark, sf)["metrics"]


# ---------------------------------------------------------------- forecasts and panels
@register("ana07_score_forecast", sql(rnd("""
WITH l AS (SELECT DISTINCT ON (gpu_uuid) gpu_uuid, time, overall_score FROM history ORDER BY gpu_uuid, time DESC),
 s AS (SELECT gpu_uuid, CASE WHEN count(*) < 2 THEN NULL
         ELSE regr_slope(overall_score, (epoch_us(time) - epoch_us(as_of)) / 3600000000.0::DOUBLE) END AS slope
       FROM history, as_of WHERE time > as_of - INTERVAL '28 days' GROUP BY 1)
SELECT gpu_uuid, l.time + to_hours(CAST(k AS INTEGER)) AS time, CAST(k AS INTEGER) AS step, overall_score + slope * k AS predicted
FROM l LEFT JOIN s USING (gpu_uuid), range(0, 25) r(k), as_of o WHERE l.time + to_hours(CAST(k AS INTEGER)) <= o.as_of + INTERVAL 24 HOUR""",
    ["predicted"]), HISTORY_CTES))
def ana07_score_forecast(spark, sf):
    """24 hourly steps of each device's score, no further than a day ahead."""
    m = _m(spark, sf)
    a = as_of_col(m)
    h = health.score_history(m, a, 4, 7, LB, "7 days", P["gap_seconds"], P["sample_seconds"], bucket="1 day")
    return finish(forecast.linear_forecast(h.select("time", "gpu_uuid", "overall_score"), "overall_score", a, 24, 3600.0, "28 days", 86400))


PANEL = ["GPU-000000", "GPU-000001", "GPU-000002"]


@register("set06_wide_panel", sql(rnd("SELECT time_bucket(INTERVAL '1 day', time) AS time, " + ", ".join(
    f"avg(gpu_temp) FILTER (gpu_uuid = '{g}') AS \"{g}\"" for g in PANEL).replace('"', '"')
    + " FROM gpu_metrics WHERE gpu_uuid IN (" + ", ".join(f"'{g}'" for g in PANEL) + ") GROUP BY 1", [f'"{g}"' for g in PANEL])))
def set06_wide_panel(spark, sf):
    """Three chosen devices side by side."""
    t = load_fleet(spark, sf)
    return finish(fleet.wide_series(fleet.long_series(t["metrics"], t["assets"], "gpu_temp"), PANEL, "1 day"))


@register("flt02_absolute_range", sql("""
SELECT time, gpu_uuid, gpu_temp FROM gpu_metrics WHERE time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'"""))
def flt02_absolute_range(spark, sf):
    return _m(spark, sf).where(between_times("time", "2024-01-10 00:00:00", "2024-01-12 12:00:00")).select("time", "gpu_uuid", "gpu_temp")


@register("flt03_chosen_datacenter", sql("""
WITH l AS (SELECT DISTINCT ON (gpu_uuid) * FROM gpu_metrics ORDER BY gpu_uuid, time DESC)
SELECT l.gpu_uuid, a.datacenter, CAST(round(CAST(gpu_temp AS DECIMAL(28,10)), 1) AS DOUBLE) AS gpu_temp,
  CAST(round(CAST(memory_temp AS DECIMAL(28,10)), 1) AS DOUBLE) AS memory_temp,
  CAST(round(CAST(power_usage AS DECIMAL(28,10)), 1) AS DOUBLE) AS power_usage,
  CAST(round(CAST(sm_active AS DECIMAL(28,10)), 1) AS DOUBLE) AS utilization, ecc_sbe_aggregate AS sbe_errors, ecc_dbe_aggregate AS dbe_errors
FROM l LEFT JOIN gpu_assets a ON l.gpu_uuid = a.gpu_uuid WHERE a.datacenter = 'ASIA'"""))
def flt03_chosen_datacenter(spark, sf):
    t = load_fleet(spark, sf)
    return fleet.status_table(t["metrics"], t["assets"], datacenter="ASIA")


@register("flt03_recent_samples_of_a_gpu", sql(rnd("""
SELECT time, gpu_temp, power_usage FROM gpu_metrics, as_of WHERE gpu_uuid = 'GPU-000001' AND time > as_of - INTERVAL '7 days'
ORDER BY time DESC""", ["gpu_temp", "power_usage"])))
def flt03_recent_samples_of_a_gpu(spark, sf):
    m = _m(spark, sf)
    return finish(fleet.recent_metrics(m, "GPU-000001", as_of_col(m), "7 days").select("time", "gpu_temp", "power_usage"))


@register("flt03_recent_scores_of_a_gpu", sql("""
SELECT time, gpu_uuid, overall_score FROM history WHERE gpu_uuid = 'GPU-000001' ORDER BY time DESC LIMIT 3""", HISTORY_CTES))
def flt03_recent_scores_of_a_gpu(spark, sf):
    m = _m(spark, sf)
    h = health.score_history(m, as_of_col(m), 4, 7, LB, "7 days", P["gap_seconds"], P["sample_seconds"], bucket="1 day")
    return fleet.recent_scores(h.select("time", "gpu_uuid", "overall_score"), "GPU-000001", 3)


@register("flt11_above_daily_p99", sql(rnd("""
WITH q AS (SELECT time_bucket(INTERVAL '1 day', time) AS t, quantile_cont(gpu_temp, 0.99) AS lim FROM gpu_metrics GROUP BY 1)
SELECT m.time, m.gpu_uuid, m.gpu_temp, q.lim AS "limit" FROM gpu_metrics m JOIN q ON time_bucket(INTERVAL '1 day', m.time) = q.t
WHERE m.gpu_temp > q.lim""", ["gpu_temp", '"limit"'])))
def flt11_above_daily_p99(spark, sf):
    return finish(design.above_quantile(_m(spark, sf), "gpu_temp", "1 day", 0.99))


# ---------------------------------------------------------------- joins
@register("jon12_stream_static_inner", sql("""
SELECT m.time, m.gpu_uuid, m.throttle_reasons, a.rack_id, a.sla_tier FROM gpu_metrics m JOIN gpu_assets a ON m.gpu_uuid = a.gpu_uuid
WHERE m.throttle_reasons > 0"""))
def jon12_stream_static_inner(spark, sf):
    t = load_fleet(spark, sf)
    ev = t["metrics"].where("throttle_reasons > 0").select("time", "gpu_uuid", "throttle_reasons")
    return design.stream_static_inner(ev, t["assets"].select("gpu_uuid", "rack_id", "sla_tier"))


@register("jon13_merged_view", sql("""
SELECT h.gpu_uuid, h.overall_score, h.health_grade, p.failure_prob_30d, p.predicted_failure_type, a.model, a.datacenter
FROM health h JOIN predictions p USING (gpu_uuid) JOIN gpu_assets a USING (gpu_uuid)""", PREDICT_CTE + "," + HEALTH_CTE))
def jon13_merged_view(spark, sf):
    t, _, h = _health(spark, sf)
    p = _predictions(spark, sf)[2]
    return design.merged_view(h.select("gpu_uuid", "overall_score", "health_grade"),
                              p.select("gpu_uuid", "failure_prob_30d", "predicted_failure_type"),
                              t["assets"].select("gpu_uuid", "model", "datacenter"))


# ---------------------------------------------------------------- projections
STORED = ["time", "gpu_uuid", *features.STORED_FEATURES]
STORED_DOUBLES = [c for c in features.STORED_FEATURES if not c.endswith("_count") and not c.endswith("_days") and not c.startswith("model_")]


@register("prj20_stored_features", sql(rnd(f"SELECT {', '.join(STORED)} FROM features", STORED_DOUBLES), FEATURE_CTE))
def prj20_stored_features(spark, sf):
    """The 27 columns that the feature table has."""
    return finish(features.project_to_table(_features(spark, sf)[2], STORED))


@register("prj23_display_probabilities", sql(rnd("""
SELECT gpu_uuid, failure_prob_7d * 100 AS p7, failure_prob_30d * 100 AS p30, failure_prob_90d * 100 AS p90 FROM predictions""",
                                                 ["p7", "p30", "p90"]), PREDICT_CTE))
def prj23_display_probabilities(spark, sf):
    p = _predictions(spark, sf)[2]
    return finish(p.select("gpu_uuid", *[(F.col(f"failure_prob_{d}d") * 100).alias(f"p{d}") for d in (7, 30, 90)]))


@register("prj24_like_and_concat", sql("""
SELECT gpu_uuid, model LIKE '%A100%' AS is_a100, starts_with(hostname, 'host-1') AS on_host_1x,
  concat(gpu_uuid, ' on ', hostname, ' (', model, ')') AS title FROM gpu_assets"""))
def prj24_like_and_concat(spark, sf):
    """Substring matches and concatenated titles (PRJ24, PRJ25)."""
    a = load_fleet(spark, sf)["assets"]
    return a.select("gpu_uuid", F.col("model").like("%A100%").alias("is_a100"), F.startswith("hostname", F.lit("host-1")).alias("on_host_1x"),
                    F.concat("gpu_uuid", F.lit(" on "), "hostname", F.lit(" ("), "model", F.lit(")")).alias("title"))


@register("prj25_test_anomaly_z", sql(rnd("""
SELECT m.gpu_uuid, max(m.gpu_temp) AS hottest, abs(max(m.gpu_temp) - avg(m.gpu_temp)) / nullif(stddev_samp(m.gpu_temp), 0) AS z
FROM gpu_metrics m GROUP BY 1""", ["hottest", "z"])))
def prj25_test_anomaly_z(spark, sf):
    """z-score of each device's hottest sample, as the trigger script works it out."""
    g = _m(spark, sf).groupBy("gpu_uuid").agg(F.max("gpu_temp").alias("hottest"), F.avg("gpu_temp").alias("_m"), F.stddev_samp("gpu_temp").alias("_s"))
    return finish(g.select("gpu_uuid", "hottest", F.try_divide(F.abs(F.col("hottest") - F.col("_m")), F.nullif(F.col("_s"), F.lit(0.0))).alias("z")))


@register("prj27_live_status", sql("""
WITH l AS (SELECT DISTINCT ON (gpu_uuid) gpu_uuid, time, gpu_temp FROM gpu_metrics ORDER BY gpu_uuid, time DESC)
SELECT gpu_uuid, time, CASE WHEN gpu_temp > 85 THEN 'critical' WHEN gpu_temp > 75 THEN 'warning' ELSE 'healthy' END AS status FROM l"""))
def prj27_live_status(spark, sf):
    last = latest.latest_per_key(_m(spark, sf), "gpu_uuid", "time", ["gpu_temp"])
    return last.select("gpu_uuid", "time", live_status("gpu_temp").alias("status"))


# ---------------------------------------------------------------- rollups and distributions
@register("agg32_sketch_errors", sql("""
SELECT time_bucket(INTERVAL '1 hour', time) AS time, count(*) AS event_count, TRUE AS gpus_close, TRUE AS p95_is_a_sample_at_rank
FROM gpu_metrics GROUP BY 1"""))
def agg32_sketch_errors(spark, sf):
    """The stream's sketches held against the exact figures of each hour: distinct devices
    within four standard errors (5 % each), the percentile at most one sample off its rank."""
    m = _m(spark, sf)
    s = rollups.fleet_buckets(m, "1 hour", exact=False).select("time", "event_count", "gpu_count", "p95_temp")
    e = rollups.fleet_buckets(m, "1 hour").select("time", F.col("gpu_count").alias("_g"))
    low = rollups.bucket_percentile(m, "1 hour", "gpu_temp", 0.90).withColumnRenamed("value", "_lo")
    high = m.groupBy(rollups.bucket("time", "1 hour").alias("time")).agg(F.max("gpu_temp").alias("_hi"))
    j = s.join(e, "time").join(low, "time").join(high, "time")
    return j.select("time", "event_count", (F.abs(F.col("gpu_count") - F.col("_g")) <= F.greatest(F.lit(1.0), F.col("_g") * 0.2)).alias("gpus_close"),
                    F.col("p95_temp").between(F.col("_lo"), F.col("_hi")).alias("p95_is_a_sample_at_rank"))


@register("agg33_hourly_fleet_kw", sql(rnd("""
SELECT time, sum(w) / 1000.0 AS fleet_kw, count(*) AS gpus FROM (
  SELECT time_bucket(INTERVAL '1 hour', time) AS time, gpu_uuid, avg(power_usage) AS w FROM gpu_metrics GROUP BY 1, 2) GROUP BY 1""", ["fleet_kw"])))
def agg33_hourly_fleet_kw(spark, sf):
    return finish(design.hourly_fleet_kw(_m(spark, sf)))


@register("agg33_under_sampled_days", sql("""
SELECT gpu_uuid, time_bucket(INTERVAL '1 day', time) AS time, count(*) AS samples FROM gpu_metrics GROUP BY 1, 2 HAVING count(*) < 3"""))
def agg33_under_sampled_days(spark, sf):
    return design.under_sampled(_m(spark, sf), "1 day", 3)


@register("agg34_risk_and_action_distribution", sql("""
SELECT 'action' AS kind, decision AS value, count(*) AS devices FROM decisions GROUP BY 2
UNION ALL SELECT 'failure type', predicted_failure_type, count(*) FROM predictions GROUP BY 2""", ECON_CTES))
def agg34_risk_and_action_distribution(spark, sf):
    d = design.grade_distribution(_decisions(spark, sf)[1], "decision").withColumnRenamed("decision", "value")
    r = design.grade_distribution(_predictions(spark, sf)[2], "predicted_failure_type").withColumnRenamed("predicted_failure_type", "value")
    return d.withColumn("kind", F.lit("action")).unionByName(r.withColumn("kind", F.lit("failure type"))).select("kind", "value", "devices")


@register("agg36_second_derivative", sql(rnd("""
SELECT gpu_uuid, time, row_number() OVER w - 1 AS row_index,
  CAST(ecc_sbe_aggregate AS DOUBLE) - 2.0 * lag(ecc_sbe_aggregate, 1) OVER w + lag(ecc_sbe_aggregate, 2) OVER w AS second_derivative
FROM gpu_metrics WINDOW w AS (PARTITION BY gpu_uuid ORDER BY time)""", ["second_derivative"])))
def agg36_second_derivative(spark, sf):
    return finish(design.second_derivative(_m(spark, sf), "ecc_sbe_aggregate"))


@register("agg37_valuation_totals", sql(rnd(f"""
SELECT count(*) AS gpus, sum(npv_keep) AS total_npv_keep, sum(npv_sell) AS total_npv_sell, sum(expected_value) AS total_expected_value,
  (SELECT CAST(sum(ecc_sbe_volatile) AS BIGINT) FROM gpu_metrics, as_of WHERE time > as_of - INTERVAL '24 hours') AS ecc_sbe_24h,
  (SELECT CAST(sum(ecc_dbe_volatile) AS BIGINT) FROM gpu_metrics, as_of WHERE time > as_of - INTERVAL '24 hours') AS ecc_dbe_24h
FROM decisions""", ["total_npv_keep", "total_npv_sell", "total_expected_value"], 2), ECON_CTES))
def agg37_valuation_totals(spark, sf):
    t, d = _decisions(spark, sf)
    return finish(design.valuation_totals(d, as_of_col(t["metrics"]), t["metrics"]), 2)


@register("ana10_three_part_scores", sql(rnd(f"""
WITH g AS (SELECT gpu_uuid, avg(gpu_temp) AS t, max(gpu_temp) AS tx, count_if(throttle_reasons > 0) AS thr, sum(ecc_sbe_volatile) AS sbe,
    sum(ecc_dbe_volatile) AS dbe, coalesce(stddev_samp(power_usage), 0) AS pv
  FROM gpu_metrics, as_of WHERE time > as_of - INTERVAL '{P['baseline']}' AND time <= as_of GROUP BY 1),
 p AS (SELECT gpu_uuid,
    greatest(0.0, least(100.0, 100.0 - CASE WHEN t > 75 THEN (t - 75) * 2 ELSE 0 END - CASE WHEN tx > 85 THEN (tx - 85) * 5 ELSE 0 END - thr * 10)) AS thermal_score,
    greatest(0.0, least(100.0, least(100.0 - least(50.0, sbe / 7.0), CASE WHEN dbe > 0 THEN 70.0 ELSE 100.0 END))) AS memory_score,
    greatest(0.0, least(100.0, 100.0 - CASE WHEN pv > 50 THEN (pv - 50) / 2 ELSE 0 END)) AS power_score FROM g)
SELECT *, CAST(round_even(CAST(thermal_score * 0.35 + memory_score * 0.45 + power_score * 0.20 AS DECIMAL(38,12)), 0) AS INTEGER) AS overall FROM p""",
    ["thermal_score", "memory_score", "power_score"])))
def ana10_three_part_scores(spark, sf):
    m = _m(spark, sf)
    return finish(design.three_part_score(m, as_of_col(m), P["baseline"]))


@register("ana10_rule_valuation", sql(f"""
WITH v AS (SELECT h.gpu_uuid, a.model, overall_score AS h, CASE WHEN a.model LIKE '%H100%' THEN 40000.0 ELSE 15000.0 END::DOUBLE AS price,
    (CASE WHEN a.model LIKE '%H100%' THEN 3.50 ELSE 1.50 END * 730 * CASE WHEN overall_score >= 85 THEN 0.90 WHEN overall_score >= 70 THEN 0.75
     WHEN overall_score >= 50 THEN 0.50 ELSE 0.25 END)::DOUBLE AS revenue, 228.0 + (100 - overall_score) * 2 AS cost
  FROM health h JOIN gpu_assets a ON h.gpu_uuid = a.gpu_uuid WHERE a.model IN ('NVIDIA H100-SXM5-80GB', 'NVIDIA A100-SXM4-80GB')),
 w AS (SELECT *, price * (0.5 + h / 100.0 * 0.7) AS residual, (revenue - cost) * 12 AS keep FROM v),
 x AS (SELECT *, CASE WHEN h >= 70 AND keep > residual THEN 'KEEP' WHEN residual > 0.5 * price THEN 'SELL' ELSE 'DECOMMISSION' END AS what FROM w)
SELECT gpu_uuid, model, h AS health_score, {', '.join(f"CAST(round(CAST({e} AS DECIMAL(38,12)), 2) AS DOUBLE) AS {n}" for n, e in (
    ('residual_value', 'residual'), ('monthly_revenue', 'revenue'), ('monthly_cost', 'cost'), ('monthly_profit', 'revenue - cost'),
    ('npv_keep_12m', 'keep'), ('expected_value', "CASE what WHEN 'KEEP' THEN keep WHEN 'SELL' THEN residual * 0.95 ELSE price * 0.10 END")))},
  what AS recommendation FROM x""", HEALTH_CTE))
def ana10_rule_valuation(spark, sf):
    t, _, h = _health(spark, sf)
    return design.rule_valuation(h, t["assets"])


@register("ana04_rule_report", sql(rnd("""
WITH x AS (SELECT CAST(f.gpu_temp_mean > 70 OR f.ecc_dbe_event_count > 0 AS INTEGER) AS y, CAST(p.failure_prob_30d >= 0.5 AS INTEGER) AS p
           FROM features f JOIN predictions p ON f.gpu_uuid = p.gpu_uuid),
 c AS (SELECT 0 AS label UNION ALL SELECT 1),
 n AS (SELECT label, count_if(y = label AND p = label) AS hit, count_if(p = label) AS said, count_if(y = label) AS support
       FROM c CROSS JOIN x GROUP BY 1)
SELECT label, CASE WHEN said > 0 THEN hit / said END AS precision, CASE WHEN support > 0 THEN hit / support END AS recall,
  CASE WHEN said + support > 0 THEN 2.0 * hit / (said + support) END AS f1, CAST(support AS BIGINT) AS support FROM n""",
    ["precision", "recall", "f1"]), PREDICT_CTE))
def ana04_rule_report(spark, sf):
    """Precision and recall of the rule score against a stand-in label (hot, or an uncorrectable error)."""
    f = _features(spark, sf)[2].select("gpu_uuid", ((F.col("gpu_temp_mean") > 70) | (F.col("ecc_dbe_event_count") > 0)).cast("int").alias("label"))
    p = _predictions(spark, sf)[2].select("gpu_uuid", (F.col("failure_prob_30d") >= 0.5).cast("int").alias("predicted"))
    return finish(predict.classification_report(f.join(p, "gpu_uuid")))


def _rolling_sql(spec: str) -> str:
    return rnd(f"""
SELECT gpu_uuid, time, gpu_temp, avg(gpu_temp) OVER w AS roll_mean, stddev_samp(gpu_temp) OVER w AS roll_std,
  max(gpu_temp) OVER w AS roll_max, min(gpu_temp) OVER w AS roll_min, count(gpu_temp) OVER w AS roll_n
FROM gpu_metrics WINDOW w AS (PARTITION BY gpu_uuid ORDER BY time RANGE BETWEEN INTERVAL {spec} PRECEDING AND CURRENT ROW)""",
               ["gpu_temp", "roll_mean", "roll_std", "roll_max", "roll_min"])


@register("win08_rolling_hour_stats", sql(_rolling_sql("1 HOUR")))
def win08_rolling_hour_stats(spark, sf):
    return finish(design.rolling_stats(_m(spark, sf), "gpu_temp", HOUR))


@register("win08_rolling_6h_stats", sql(_rolling_sql("6 HOUR")))
def win08_rolling_6h_stats(spark, sf):
    return finish(design.rolling_stats(_m(spark, sf), "gpu_temp", 6 * HOUR))


@register("win08_rolling_week_stats", sql(_rolling_sql("7 DAY")))
def win08_rolling_week_stats(spark, sf):
    return finish(design.rolling_stats(_m(spark, sf), "gpu_temp", 7 * DAY))


# ---------------------------------------------------------------- training rows and top lists
@register("top05_last_100_feature_rows", sql(rnd("""
SELECT f.gpu_uuid, l.t AS time, gpu_temp_mean, power_usage_mean FROM features f
JOIN (SELECT gpu_uuid, max(time) AS t FROM fw GROUP BY 1) l ON f.gpu_uuid = l.gpu_uuid
ORDER BY l.t DESC, f.gpu_uuid LIMIT 100""", ["gpu_temp_mean", "power_usage_mean"]), FEATURE_CTE))
def top05_last_100_feature_rows(spark, sf):
    """The 100 newest feature rows: the limit is the trainer's feature."""
    t = load_fleet(spark, sf)
    f = features.gpu_features(t["metrics"], t["assets"], as_of_col(t["metrics"]), f"{LB} days", trend_bucket="1 day", stamp_last=True)
    return finish(f.select("gpu_uuid", "time", "gpu_temp_mean", "power_usage_mean").orderBy(F.col("time").desc(), "gpu_uuid").limit(100))


@register("set05_replicated_rows", sql("""
WITH l AS (SELECT DISTINCT ON (gpu_uuid) gpu_uuid, time FROM gpu_metrics ORDER BY gpu_uuid, time DESC)
SELECT gpu_uuid, time, CAST(k AS INTEGER) AS copy_no FROM l, range(1, 4) r(k)"""))
def set05_replicated_rows(spark, sf):
    """Latest rows, each three times (a trainer that asks for three times as many)."""
    last = latest.latest_per_key(_m(spark, sf), "gpu_uuid", "time", []).select("gpu_uuid", "time")
    return forecast.replicate_to(last, 3, 1)


@register("top06_degrading_and_at_risk", sql(rnd("""
WITH d AS (SELECT gpu_uuid, CASE WHEN count(*) > 1 THEN regr_slope(overall_score, epoch(time) / 86400.0) END AS rate
           FROM history GROUP BY 1)
SELECT * FROM (SELECT 'degrading' AS list, gpu_uuid, rate AS measure FROM d WHERE rate IS NOT NULL ORDER BY round(rate, 9), gpu_uuid LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'at risk', gpu_uuid, failure_prob_30d FROM predictions ORDER BY failure_prob_30d DESC, gpu_uuid LIMIT 10)""",
    ["measure"]), PREDICT_CTE + "," + HISTORY_CTES))
def top06_degrading_and_at_risk(spark, sf):
    """Ten fastest degrading scores and ten likeliest failures: the limits are the reports'."""
    m = _m(spark, sf)
    h = health.score_history(m, as_of_col(m), 4, 7, LB, "7 days", P["gap_seconds"], P["sample_seconds"], bucket="1 day")
    day = F.unix_seconds("time") / 86400.0
    rate = h.groupBy("gpu_uuid").agg(F.regr_slope("overall_score", day).alias("measure")).where(F.col("measure").isNotNull())
    p = _predictions(spark, sf)[2].select("gpu_uuid", F.col("failure_prob_30d").alias("measure"))
    return finish(rate.orderBy(F.round("measure", 9), "gpu_uuid").limit(10).withColumn("list", F.lit("degrading")).unionByName(
        p.orderBy(F.col("measure").desc(), "gpu_uuid").limit(10).withColumn("list", F.lit("at risk"))))


# ---------------------------------------------------------------- whole events
EVENT_FIELDS = {
    "memory_temp_c": ("health", "memory_temp"), "power_usage_w": ("health", "power_usage"), "throttle_reasons": ("health", "throttle_reasons"),
    "ecc_sbe_volatile": ("memory", "ecc_sbe_volatile"), "ecc_dbe_volatile": ("memory", "ecc_dbe_volatile"),
    "ecc_sbe_aggregate": ("memory", "ecc_sbe_aggregate"), "ecc_dbe_aggregate": ("memory", "ecc_dbe_aggregate"),
    "retired_pages_sbe": ("memory", "retired_pages_sbe"), "retired_pages_dbe": ("memory", "retired_pages_dbe"),
    "sm_active_pct": ("performance", "sm_active"), "sm_occupancy_pct": ("performance", "sm_occupancy"),
    "tensor_active_pct": ("performance", "tensor_active"), "dram_active_pct": ("performance", "dram_active"),
    "gpu_utilization_pct": ("performance", "gpu_utilization"), "memory_copy_utilization_pct": ("performance", "mem_copy_utilization"),
    "sm_clock_mhz": ("clocks", "sm_clock_mhz"), "mem_clock_mhz": ("clocks", "mem_clock_mhz"),
}
EVENT_DOUBLES = [k for k, (s, _) in EVENT_FIELDS.items() if s == "performance"] + ["memory_temp_c", "power_usage_w", "gpu_temp_c", "pcie_rx_mb_per_sec"]


@register("prj03_event_fields", sql(rnd(f"""
SELECT gpu_uuid, time, '1.0' AS schema_version, 'gpu_metric_sample' AS event_type,
  strftime(time, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp, hostname, CAST(device_index AS INTEGER) AS device_index,
  CASE WHEN device_index % 2 = 0 THEN 'NVIDIA A100-SXM4-80GB' ELSE 'NVIDIA H100-SXM5-80GB' END AS name,
  gpu_temp AS gpu_temp_c, pcie_rx_bytes_per_sec / 1048576.0 AS pcie_rx_mb_per_sec, fb_free_bytes // 1048576 AS fb_free_mib,
  {', '.join(f'{c} AS {k}' for k, (_, c) in EVENT_FIELDS.items())}, collection_latency_ms, FALSE AS stale, 1 AS sample_count
FROM gpu_metrics""", EVENT_DOUBLES)))
def prj03_event_fields(spark, sf):
    """The remaining fields of the nested event."""
    ev = ingest.build_events(_m(spark, sf), model=device_model(F.col("device_index")))
    e, x = F.col("e"), F.col("e")["metrics"]
    return finish(ev.select(
        "gpu_uuid", "time", e["schema_version"].alias("schema_version"), e["event_type"].alias("event_type"), e["timestamp"].alias("timestamp"),
        e["host"]["hostname"].alias("hostname"), e["gpu"]["device_index"].alias("device_index"), e["gpu"]["name"].alias("name"),
        x["health"]["gpu_temp_c"].alias("gpu_temp_c"), x["performance"]["pcie_rx_mb_per_sec"].alias("pcie_rx_mb_per_sec"),
        x["memory"]["fb_free_mib"].alias("fb_free_mib"), *[x[s][k].alias(k) for k, (s, _) in EVENT_FIELDS.items()],
        e["quality"]["collection_latency_ms"].alias("collection_latency_ms"), e["quality"]["stale"].alias("stale"),
        e["quality"]["sample_count"].alias("sample_count")))

"""Registered read-side queries: rollups, latest rows, fleet/datacenter/rack views."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions.timewin import as_of_col
from fleetscope.operators import fleet, latest, rollups
from fleetscope.plans.catalog import DRIVER_PARAMS as P
from fleetscope.plans.catalog import finish, register, rnd
from fleetscope.plans.oracle import sql
from fleetscope.sources.driver import load_fleet

ROLLUP_DOUBLES = ["gpu_temp_avg", "gpu_temp_max", "gpu_temp_min", "memory_temp_avg", "memory_temp_max",
                  "power_usage_avg", "power_usage_max", "sm_active_avg", "sm_active_max",
                  "memory_util_avg", "memory_util_max"]


def _rollup_sql(width: str, power_min: bool) -> str:
    pm = "min(power_usage) AS power_usage_min," if power_min else ""
    body = f"""
SELECT time_bucket(INTERVAL '{width}', time) AS time, gpu_uuid, hostname,
  avg(gpu_temp) AS gpu_temp_avg, max(gpu_temp) AS gpu_temp_max, min(gpu_temp) AS gpu_temp_min,
  avg(memory_temp) AS memory_temp_avg, max(memory_temp) AS memory_temp_max,
  avg(power_usage) AS power_usage_avg, max(power_usage) AS power_usage_max, {pm}
  avg(sm_active) AS sm_active_avg, max(sm_active) AS sm_active_max,
  avg(memory_utilization) AS memory_util_avg, max(memory_utilization) AS memory_util_max,
  CAST(sum(ecc_sbe_volatile) AS BIGINT) AS ecc_sbe_count, CAST(sum(ecc_dbe_volatile) AS BIGINT) AS ecc_dbe_count,
  count(*) AS sample_count
FROM gpu_metrics GROUP BY 1, 2, 3"""
    return sql(rnd(body, ROLLUP_DOUBLES + (["power_usage_min"] if power_min else [])))


for _lvl, (_w, _pm) in rollups.LEVELS.items():
    _key = {"1min": "agg01_rollup_1min", "5min": "agg02_rollup_5min", "1hour": "agg03_rollup_1hour",
            "1day": "agg38_rollup_1day"}[_lvl]

    def _mk(level=_lvl):
        def q(spark, sf):
            return finish(rollups.rollup_level(load_fleet(spark, sf)["metrics"], level))
        return q
    register(_key, _rollup_sql(_w, _pm))(_mk())


LATEST_SQL_COLS = ("time, gpu_uuid, hostname, gpu_temp, memory_temp, power_usage, throttle_reasons, "
                   "memory_utilization, sm_active, ecc_dbe_volatile, ecc_sbe_volatile, ecc_sbe_aggregate, "
                   "ecc_dbe_aggregate")


@register("win01_latest_per_gpu", sql(rnd(f"""
SELECT DISTINCT ON (gpu_uuid) {LATEST_SQL_COLS}
FROM gpu_metrics ORDER BY gpu_uuid, time DESC""", ["gpu_temp", "memory_temp", "power_usage",
                                                  "memory_utilization", "sm_active"])))
def win01_latest_per_gpu(spark, sf):
    return finish(fleet.latest_metrics(load_fleet(spark, sf)["metrics"]))


@register("agg06_fleet_summary", sql(rnd("""
SELECT count(DISTINCT gpu_uuid) AS total_gpus, avg(gpu_temp) AS avg_temp, max(gpu_temp) AS max_temp,
  avg(power_usage) AS avg_power,
  CAST(sum(CASE WHEN throttle_reasons > 0 THEN 1 ELSE 0 END) AS BIGINT) AS throttling_count,
  CAST(sum(CASE WHEN ecc_dbe_volatile > 0 THEN 1 ELSE 0 END) AS BIGINT) AS dbe_error_count
FROM (SELECT DISTINCT ON (gpu_uuid) * FROM gpu_metrics ORDER BY gpu_uuid, time DESC) l""",
                                         ["avg_temp", "max_temp", "avg_power"])))
def agg06_fleet_summary(spark, sf):
    return finish(fleet.fleet_summary(fleet.latest_metrics(load_fleet(spark, sf)["metrics"])))


@register("agg07_fleet_scalars", sql(rnd("""
SELECT avg(gpu_temp) AS avg_temp, max(gpu_temp) AS max_temp, sum(power_usage) AS total_power,
  avg(sm_active) AS avg_utilization, CAST(sum(ecc_sbe_aggregate) AS BIGINT) AS total_sbe, CAST(sum(ecc_dbe_aggregate) AS BIGINT) AS total_dbe
FROM (SELECT DISTINCT ON (m.gpu_uuid) m.* FROM gpu_metrics m LEFT JOIN gpu_assets a ON m.gpu_uuid = a.gpu_uuid
      ORDER BY m.gpu_uuid, m.time DESC) l""", ["avg_temp", "max_temp", "total_power", "avg_utilization"])))
def agg07_fleet_scalars(spark, sf):
    t = load_fleet(spark, sf)
    return finish(fleet.fleet_scalars(t["metrics"], t["assets"], "All", "All"))


@register("agg07_datacenter_scalars", sql(rnd("""
WITH l AS (SELECT DISTINCT ON (gpu_uuid) * FROM gpu_metrics ORDER BY gpu_uuid, time DESC),
 lf AS (SELECT DISTINCT ON (gpu_uuid) * FROM gpu_metrics
        WHERE time > (SELECT as_of FROM as_of) - INTERVAL '1 day' ORDER BY gpu_uuid, time DESC),
 c AS (SELECT datacenter, count(DISTINCT gpu_uuid) AS total_gpus FROM gpu_datacenter_mapping GROUP BY 1),
 a AS (SELECT m.datacenter, avg(l.sm_active) AS avg_utilization, CAST(sum(l.ecc_sbe_aggregate) AS BIGINT) AS total_sbe,
              CAST(sum(l.ecc_dbe_aggregate) AS BIGINT) AS total_dbe
       FROM l JOIN gpu_datacenter_mapping m ON l.gpu_uuid = m.gpu_uuid GROUP BY 1),
 f AS (SELECT m.datacenter, avg(lf.gpu_temp) AS avg_temp, sum(lf.power_usage) AS total_power
       FROM lf JOIN gpu_datacenter_mapping m ON lf.gpu_uuid = m.gpu_uuid GROUP BY 1)
SELECT c.datacenter, c.total_gpus, a.avg_utilization, a.total_sbe, a.total_dbe, f.avg_temp, f.total_power
FROM c LEFT JOIN a ON c.datacenter = a.datacenter LEFT JOIN f ON c.datacenter = f.datacenter""",
                                              ["avg_utilization", "avg_temp", "total_power"])))
def agg07_datacenter_scalars(spark, sf):
    t = load_fleet(spark, sf)
    m = t["metrics"]
    return finish(fleet.datacenter_scalars(m, t["mapping"], as_of_col(m), fresh=P["recent"]))


@register("agg08_datacenter_gpu_count", sql("""
SELECT datacenter, count(DISTINCT gpu_uuid) AS total_gpus FROM gpu_datacenter_mapping GROUP BY 1"""))
def agg08_datacenter_gpu_count(spark, sf):
    return fleet.datacenter_gpu_count(load_fleet(spark, sf)["mapping"])


@register("agg09_rack_summary", sql("""
WITH latest AS (SELECT DISTINCT ON (gpu_uuid) gpu_uuid, time, gpu_temp, power_usage, sm_active
                FROM gpu_metrics ORDER BY gpu_uuid, time DESC)
SELECT m.datacenter, m.rack_id, count(l.time) AS gpu_count,
  CAST(round(CAST(avg(l.gpu_temp) AS DECIMAL(28,10)), 1) AS DOUBLE) AS avg_temp,
  CAST(round(CAST(sum(l.power_usage) AS DECIMAL(28,10)), 1) AS DOUBLE) AS total_power,
  CAST(round(CAST(avg(l.sm_active) AS DECIMAL(28,10)), 1) AS DOUBLE) AS avg_utilization
FROM gpu_datacenter_mapping m LEFT JOIN latest l ON m.gpu_uuid = l.gpu_uuid
GROUP BY 1, 2"""))
def agg09_rack_summary(spark, sf):
    t = load_fleet(spark, sf)
    return finish(fleet.rack_summary(t["metrics"], t["mapping"]))


@register("agg10_gpu_stats_window", sql(rnd("""
SELECT gpu_uuid, count(*) AS sample_count, avg(gpu_temp) AS avg_temp, min(gpu_temp) AS min_temp,
  max(gpu_temp) AS max_temp, avg(power_usage) AS avg_power, max(power_usage) AS max_power,
  avg(sm_active) AS avg_utilization,
  CAST(sum(CASE WHEN throttle_reasons > 0 THEN 1 ELSE 0 END) AS BIGINT) AS throttle_events,
  CAST(sum(CASE WHEN ecc_dbe_volatile > 0 THEN 1 ELSE 0 END) AS BIGINT) AS dbe_error_events
FROM gpu_metrics WHERE time > (SELECT as_of FROM as_of) - INTERVAL '7 days'
GROUP BY gpu_uuid""", ["avg_temp", "min_temp", "max_temp", "avg_power", "max_power", "avg_utilization"])))
def agg10_gpu_stats_window(spark, sf):
    m = load_fleet(spark, sf)["metrics"]
    return finish(fleet.gpu_stats(m, as_of_col(m), "7 days"))


@register("agg11_list_gpus", sql("""
SELECT m.gpu_uuid, m.hostname, a.model, max(m.time) AS last_seen
FROM gpu_metrics m LEFT JOIN gpu_assets a ON m.gpu_uuid = a.gpu_uuid
WHERE m.time > (SELECT as_of FROM as_of) - INTERVAL '1 day'
GROUP BY 1, 2, 3"""))
def agg11_list_gpus(spark, sf):
    t = load_fleet(spark, sf)
    m = t["metrics"]
    return fleet.list_gpus(m, t["assets"], as_of_col(m), P["active"])


@register("agg15_datacenter_racks", sql("""
SELECT datacenter, count(*) AS gpu_count, string_agg(DISTINCT rack_id, ', ' ORDER BY rack_id) AS racks
FROM gpu_assets GROUP BY 1"""))
def agg15_datacenter_racks(spark, sf):
    return fleet.datacenter_racks(load_fleet(spark, sf)["assets"])


@register("jon03_datacenter_gpu_table", sql("""
WITH latest AS (SELECT DISTINCT ON (gpu_uuid) gpu_uuid, gpu_temp, power_usage, sm_active,
                  ecc_sbe_aggregate, ecc_dbe_aggregate FROM gpu_metrics ORDER BY gpu_uuid, time DESC)
SELECT m.datacenter, m.rack_id, l.gpu_uuid,
  CAST(round(CAST(l.gpu_temp AS DECIMAL(28,10)), 1) AS DOUBLE) AS gpu_temp,
  CAST(round(CAST(l.power_usage AS DECIMAL(28,10)), 1) AS DOUBLE) AS power_usage,
  CAST(round(CAST(l.sm_active AS DECIMAL(28,10)), 1) AS DOUBLE) AS utilization,
  l.ecc_sbe_aggregate AS sbe_errors, l.ecc_dbe_aggregate AS dbe_errors
FROM gpu_datacenter_mapping m JOIN latest l ON m.gpu_uuid = l.gpu_uuid
ORDER BY m.datacenter, l.gpu_temp DESC"""))
def jon03_datacenter_gpu_table(spark, sf):
    t = load_fleet(spark, sf)
    return fleet.datacenter_gpu_table(t["metrics"], t["mapping"])


@register("top02_status_table", sql("""
SELECT m.gpu_uuid, a.datacenter,
  CAST(round(CAST(m.gpu_temp AS DECIMAL(28,10)), 1) AS DOUBLE) AS gpu_temp,
  CAST(round(CAST(m.memory_temp AS DECIMAL(28,10)), 1) AS DOUBLE) AS memory_temp,
  CAST(round(CAST(m.power_usage AS DECIMAL(28,10)), 1) AS DOUBLE) AS power_usage,
  CAST(round(CAST(m.sm_active AS DECIMAL(28,10)), 1) AS DOUBLE) AS utilization,
  m.ecc_sbe_aggregate AS sbe_errors, m.ecc_dbe_aggregate AS dbe_errors
FROM (SELECT DISTINCT ON (gpu_uuid) * FROM gpu_metrics ORDER BY gpu_uuid, time DESC) m
LEFT JOIN gpu_assets a ON m.gpu_uuid = a.gpu_uuid
ORDER BY m.gpu_temp DESC NULLS FIRST"""))
def top02_status_table(spark, sf):
    t = load_fleet(spark, sf)
    return fleet.status_table(t["metrics"], t["assets"])


@register("top01_latest_20_per_gpu", sql(rnd("""
SELECT time, gpu_uuid, gpu_temp, memory_temp, power_usage, sm_active, memory_utilization, CAST(recency_rank AS INTEGER) AS recency_rank
FROM (SELECT *, row_number() OVER (PARTITION BY gpu_uuid ORDER BY time DESC) AS recency_rank FROM gpu_metrics)
WHERE recency_rank <= 20""", ["gpu_temp", "memory_temp", "power_usage", "sm_active", "memory_utilization"])))
def top01_latest_20_per_gpu(spark, sf):
    m = load_fleet(spark, sf)["metrics"].select("time", "gpu_uuid", "gpu_temp", "memory_temp", "power_usage",
                                                 "sm_active", "memory_utilization")
    return finish(latest.latest_n_per_key(m, 20))


@register("set01_datacenter_dropdown", sql("""
SELECT 'All' AS value UNION SELECT DISTINCT datacenter FROM gpu_assets ORDER BY 1"""))
def set01_datacenter_dropdown(spark, sf):
    return fleet.dropdown_values(load_fleet(spark, sf)["assets"], "datacenter")


@register("src08_distinct_gpus", sql("""
SELECT DISTINCT gpu_uuid AS value FROM gpu_metrics ORDER BY 1"""))
def src08_distinct_gpus(spark, sf):
    return fleet.dropdown_values(load_fleet(spark, sf)["metrics"], "gpu_uuid", with_all=False)


@register("agg04_datacenter_power_10s", sql(rnd("""
SELECT d.datacenter, time_bucket(INTERVAL '10 seconds', m.time) AS time, sum(m.power_usage) AS total_power
FROM gpu_metrics m JOIN gpu_datacenter_mapping d ON m.gpu_uuid = d.gpu_uuid
GROUP BY 1, 2""", ["total_power"])))
def agg04_datacenter_power_10s(spark, sf):
    t = load_fleet(spark, sf)
    return finish(rollups.group_series(t["metrics"], t["mapping"], "10 seconds", "datacenter", "power_usage",
                                       "sum", "total_power"))


@register("agg05_datacenter_util_10s", sql(rnd("""
SELECT d.datacenter, time_bucket(INTERVAL '10 seconds', m.time) AS time, avg(m.sm_active) AS avg_utilization
FROM gpu_metrics m JOIN gpu_datacenter_mapping d ON m.gpu_uuid = d.gpu_uuid
GROUP BY 1, 2""", ["avg_utilization"])))
def agg05_datacenter_util_10s(spark, sf):
    t = load_fleet(spark, sf)
    return finish(rollups.group_series(t["metrics"], t["mapping"], "10 seconds", "datacenter", "sm_active",
                                       "avg", "avg_utilization"))


@register("flt04_active_gpus", sql("""
SELECT DISTINCT gpu_uuid FROM gpu_metrics WHERE time > (SELECT as_of FROM as_of) - INTERVAL '1 day'"""))
def flt04_active_gpus(spark, sf):
    m = load_fleet(spark, sf)["metrics"]
    return fleet.active_devices(m, as_of_col(m), P["active"])


@register("flt07_rows_at_group_max", sql(rnd("""
SELECT m.gpu_uuid, m.time, m.gpu_temp FROM gpu_metrics m
WHERE m.gpu_temp = (SELECT max(x.gpu_temp) FROM gpu_metrics x WHERE x.gpu_uuid = m.gpu_uuid)""",
                                              ["gpu_temp"])))
def flt07_rows_at_group_max(spark, sf):
    m = load_fleet(spark, sf)["metrics"].select("gpu_uuid", "time", "gpu_temp")
    return finish(latest.rows_at_group_max(m, "gpu_uuid", "gpu_temp"))


@register("flt08_global_latest_snapshot", sql(rnd("""
SELECT gpu_uuid, time, gpu_temp FROM gpu_metrics WHERE time = (SELECT max(time) FROM gpu_metrics)""",
                                                   ["gpu_temp"])))
def flt08_global_latest_snapshot(spark, sf):
    m = load_fleet(spark, sf)["metrics"].select("gpu_uuid", "time", "gpu_temp")
    return finish(latest.global_latest_snapshot(m))


@register("set06_long_series_temp", sql(rnd("""
SELECT m.time, m.gpu_uuid AS metric, m.gpu_temp AS value
FROM gpu_metrics m LEFT JOIN gpu_assets a ON m.gpu_uuid = a.gpu_uuid""", ["value"])))
def set06_long_series_temp(spark, sf):
    t = load_fleet(spark, sf)
    return finish(fleet.long_series(t["metrics"], t["assets"], "gpu_temp"))

"""Registered table operations as pure frames: insert-ignore (SNK2), full and partial
upsert (SNK3, SNK4, SNK7) and acknowledgement (SNK11), with their oracles.

Stored rows and incoming rows are overlapping time ranges of the telemetry (or the
asset dimension and a changed part of it), so each query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions.timewin import as_of_col, interval
from fleetscope.operators import tables
from fleetscope.plans.catalog import finish, register, rnd
from fleetscope.plans.oracle import sql
from fleetscope.plans.q_analytics import ANOMALY_CTE, _anoms
from fleetscope.sources.driver import load_fleet


@register("snk02_insert_ignore", sql(rnd("""
WITH old AS (SELECT time, gpu_uuid, gpu_temp, power_usage FROM gpu_metrics, as_of WHERE time <= as_of - INTERVAL '10 days'),
 inc AS (SELECT time, gpu_uuid, gpu_temp, power_usage, 1 AS arrival FROM gpu_metrics, as_of WHERE time > as_of - INTERVAL '15 days'
         UNION ALL SELECT time, gpu_uuid, gpu_temp + 1, power_usage, 2 FROM gpu_metrics, as_of WHERE time > as_of - INTERVAL '5 days'),
 one AS (SELECT DISTINCT ON (time, gpu_uuid) * FROM inc ORDER BY time, gpu_uuid, arrival)
SELECT time, gpu_uuid, gpu_temp, power_usage FROM one ANTI JOIN old USING (time, gpu_uuid)""", ["gpu_temp", "power_usage"])))
def snk02_insert_ignore(spark, sf):
    """Rows inserted when ten stored days and five days of second versions come in again."""
    m = load_fleet(spark, sf)["metrics"]
    a = as_of_col(m)
    rows = m.select("time", "gpu_uuid", "gpu_temp", "power_usage")
    old = rows.where(F.col("time") <= a - interval("10 days"))
    new = rows.where(F.col("time") > a - interval("15 days")).withColumn("arrival", F.lit(1))
    again = rows.where(F.col("time") > a - interval("5 days")).withColumn("gpu_temp", F.col("gpu_temp") + 1).withColumn("arrival", F.lit(2))
    return finish(tables.ignore_frame(new.unionByName(again), old, ["time", "gpu_uuid"], "arrival").drop("arrival"))


CHANGED = """
WITH changed AS (SELECT gpu_uuid, model, concat(rack_id, '-moved') AS rack_id, 'platinum' AS sla_tier, expected_eol
                 FROM gpu_assets WHERE datacenter = 'ASIA'
                 UNION ALL SELECT concat(gpu_uuid, '-new'), model, rack_id, sla_tier, expected_eol FROM gpu_assets WHERE datacenter = 'EUROPE')"""


def _changed(spark, sf):
    assets = load_fleet(spark, sf)["assets"]
    cols = ["gpu_uuid", "model", "rack_id", "sla_tier", "expected_eol"]
    moved = assets.where("datacenter = 'ASIA'").withColumns({"rack_id": F.concat("rack_id", F.lit("-moved")), "sla_tier": F.lit("platinum")})
    new = assets.where("datacenter = 'EUROPE'").withColumn("gpu_uuid", F.concat("gpu_uuid", F.lit("-new")))
    return assets.select(*cols), moved.select(*cols).unionByName(new.select(*cols))


@register("snk03_dimension_upsert", sql(CHANGED + """
SELECT coalesce(c.gpu_uuid, a.gpu_uuid) AS gpu_uuid, CASE WHEN c.gpu_uuid IS NOT NULL THEN c.model ELSE a.model END AS model,
  CASE WHEN c.gpu_uuid IS NOT NULL THEN c.rack_id ELSE a.rack_id END AS rack_id,
  CASE WHEN c.gpu_uuid IS NOT NULL THEN c.sla_tier ELSE a.sla_tier END AS sla_tier,
  CASE WHEN c.gpu_uuid IS NOT NULL THEN c.expected_eol ELSE a.expected_eol END AS expected_eol
FROM gpu_assets a FULL JOIN changed c ON a.gpu_uuid = c.gpu_uuid"""))
def snk03_dimension_upsert(spark, sf):
    """The asset dimension after a full upsert keyed by device."""
    old, new = _changed(spark, sf)
    return tables.upsert_frame(new, old, ["gpu_uuid"])


@register("snk04_partial_upsert", sql(CHANGED + """
SELECT coalesce(c.gpu_uuid, a.gpu_uuid) AS gpu_uuid, coalesce(a.model, c.model) AS model,
  CASE WHEN c.gpu_uuid IS NOT NULL THEN c.rack_id ELSE a.rack_id END AS rack_id,
  coalesce(a.sla_tier, c.sla_tier) AS sla_tier, coalesce(a.expected_eol, c.expected_eol) AS expected_eol,
  CASE WHEN c.gpu_uuid IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at
FROM gpu_assets a FULL JOIN changed c ON a.gpu_uuid = c.gpu_uuid"""))
def snk04_partial_upsert(spark, sf):
    """The same, updating the rack only and stamping ``updated_at`` (SNK4, SNK7)."""
    old, new = _changed(spark, sf)
    at = lambda x: F.lit(x).cast("timestamp")
    return tables.upsert_frame(new, old.withColumn("updated_at", at("2024-01-01")), ["gpu_uuid"], ["rack_id"], at("2024-02-01"))


@register("snk11_acknowledge", sql(rnd("""
SELECT time, gpu_uuid, anomaly_type, value, severity = 'medium' AS acknowledged,
  CASE WHEN severity = 'medium' THEN o.as_of END AS acknowledged_at, CASE WHEN severity = 'medium' THEN 'oncall' END AS acknowledged_by
FROM anomalies, as_of o""", ["value"]), ANOMALY_CTE))
def snk11_acknowledge(spark, sf):
    """All anomalies after those of medium severity were acknowledged."""
    m, a, an = _anoms(spark, sf)
    named = an.where("severity = 'medium'")
    return finish(tables.acknowledge_frame(an, named, "oncall", a).select(
        "time", "gpu_uuid", "anomaly_type", "value", "acknowledged", "acknowledged_at", "acknowledged_by"))

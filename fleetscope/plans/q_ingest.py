"""Registered ingest queries: exposition parsing, event building, validation,
dead letters, enrichment and flattening (batch forms of the streaming job)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.operators import enrich, ingest, validate
from fleetscope.plans.catalog import finish, register, rnd
from fleetscope.plans.oracle import sql
from fleetscope.sources.driver import as_topic, device_model, load_fleet, raw_event_stream

MODEL_SQL = ("CASE WHEN device_index % 2 = 0 THEN 'NVIDIA A100-SXM4-80GB' "
             "ELSE 'NVIDIA H100-SXM5-80GB' END")


# series name -> SQL of the value that the parser must return
SERIES_SQL = {name: f"CAST({c.replace(' div ', ' // ')} AS DOUBLE)" for name, c in ingest.EXPOSITION_SERIES}
SERIES_COLS = [name.lower() for name in SERIES_SQL]


@register("src01_exposition_parse", sql(rnd(f"""
SELECT gpu_uuid, time, {MODEL_SQL} AS model, CAST(device_index AS INTEGER) AS device_index,
  {', '.join(f'{c} AS {name.lower()}' for name, c in SERIES_SQL.items())}, {len(SERIES_SQL)} AS series
FROM gpu_metrics""", SERIES_COLS)))
def src01_exposition_parse(spark, sf):
    """Every other sample is rendered without the optional timestamp."""
    m = load_fleet(spark, sf)["metrics"]
    lines = ingest.exposition_lines(as_topic(m), device_model(F.col("device_index")), stamped=F.unix_micros("time") % 2 == 0)
    p = ingest.parse_exposition(lines)
    mm = F.col("metrics")
    return finish(p.select("gpu_uuid", "time", "model", "device_index",
                           *[mm[name].alias(name.lower()) for name in SERIES_SQL], F.size(F.map_keys(mm)).alias("series")))


@register("prj03_build_events", sql(rnd(f"""
SELECT gpu_uuid, time, split_part(gpu_uuid, '-', 2) AS gpu_id,
  printf('0000:%02X:00.0', device_index + 59) AS pci_bus_id,
  CASE WHEN device_index % 2 = 0 THEN 'Ampere' ELSE 'Hopper' END AS architecture,
  CASE WHEN device_index % 2 = 0 THEN '8.0' ELSE '9.0' END AS compute_capability,
  to_json(list_filter([CASE WHEN (throttle_reasons & 8) > 0 THEN 'HW_SLOWDOWN' END,
    CASE WHEN (throttle_reasons & 64) > 0 THEN 'HW_THERMAL' END,
    CASE WHEN (throttle_reasons & 128) > 0 THEN 'HW_POWER_BRAKE' END,
    CASE WHEN (throttle_reasons & 4) > 0 THEN 'SW_POWER_CAP' END,
    CASE WHEN (throttle_reasons & 32) > 0 THEN 'SW_THERMAL' END], lambda x: x IS NOT NULL))::VARCHAR
    AS throttle_decoded,
  fb_used_bytes // 1048576 AS fb_used_mib, fb_used_bytes // 1048576 + fb_free_bytes // 1048576 AS fb_total_mib,
  CAST(fb_used_bytes // 1048576 AS DOUBLE) / CAST(fb_used_bytes // 1048576 + fb_free_bytes // 1048576 AS DOUBLE)
    * 100.0 AS utilization_pct,
  pcie_tx_bytes_per_sec / 1048576.0 AS pcie_tx_mb_per_sec
FROM gpu_metrics""", ["utilization_pct", "pcie_tx_mb_per_sec"])))
def prj03_build_events(spark, sf):
    m = load_fleet(spark, sf)["metrics"]
    ev = ingest.build_events(m, model=device_model(F.col("device_index")))
    e = F.col("e")
    return finish(ev.select(
        "gpu_uuid", "time", e["gpu"]["gpu_id"].alias("gpu_id"), e["gpu"]["pci_bus_id"].alias("pci_bus_id"),
        e["gpu"]["architecture"].alias("architecture"), e["gpu"]["compute_capability"].alias("compute_capability"),
        F.to_json(e["metrics"]["health"]["throttle_reasons_decoded"]).alias("throttle_decoded"),
        e["metrics"]["memory"]["fb_used_mib"].alias("fb_used_mib"),
        e["metrics"]["memory"]["fb_total_mib"].alias("fb_total_mib"),
        e["metrics"]["memory"]["utilization_pct"].alias("utilization_pct"),
        e["metrics"]["performance"]["pcie_tx_mb_per_sec"].alias("pcie_tx_mb_per_sec")))


# Expected validation outcome of the raw stand-in stream, written from its rules.
VALIDATION_CTE = """
vraw AS (SELECT *, epoch_us(time) % 1000 AS g, ((epoch_us(time) % 1000) % 90 - 10) * 60 AS age FROM gpu_metrics),
verr AS (
  SELECT gpu_uuid AS key, time,
    CASE WHEN g BETWEEN 5 AND 7 THEN ['Missing metrics.clocks']
         WHEN g = 8 THEN ['Missing gpu.gpu_uuid']
         ELSE list_filter([
           CASE WHEN g BETWEEN 0 AND 4 AND gpu_temp + 80.0 > 120 THEN
             'GPU temperature out of range: ' || CAST(gpu_temp + 80.0 AS VARCHAR) || '°C (expected 0-120)' END,
           CASE WHEN g = 10 THEN 'sm_active_pct out of range: 101.0% (expected 0-100)' END,
           CASE WHEN g = 9 THEN 'SM clock out of range: 50 MHz (expected 100-3000)' END,
           CASE WHEN age > 3600 THEN printf('Event timestamp too old: %.0fs (>1 hour)', CAST(age AS DOUBLE)) END,
           CASE WHEN age < -300 THEN printf('Event timestamp in future: %.0fs', CAST(-age AS DOUBLE)) END],
           lambda x: x IS NOT NULL) END AS errors
  FROM vraw)"""


def _checked(spark, sf):
    t = load_fleet(spark, sf)
    raw = raw_event_stream(t["metrics"])
    return t, validate.validate(raw, now=F.col("received_at"))


@register("val05_validation_errors", sql("""
SELECT key, time, len(errors) = 0 AS is_valid, to_json(errors)::VARCHAR AS errors FROM verr""", VALIDATION_CTE))
def val05_validation_errors(spark, sf):
    t, c = _checked(spark, sf)
    return c.select("key", "time", "is_valid", F.to_json("errors").alias("errors"))


@register("val07_error_breakdown", sql("""
SELECT split_part(e, ':', 1) AS error_type, count(*) AS n, CAST(NULL AS DOUBLE) AS pct
FROM (SELECT unnest(errors) AS e FROM verr) GROUP BY 1
UNION ALL SELECT CASE WHEN len(errors) = 0 THEN '__valid__' ELSE '__invalid__' END, count(*),
  CAST(round(CAST(count(*) / (SELECT count(*) FROM verr) * 100.0 AS DECIMAL(28,10)), 1) AS DOUBLE) FROM verr GROUP BY 1""", VALIDATION_CTE))
def val07_error_breakdown(spark, sf):
    t, c = _checked(spark, sf)
    return validate.error_breakdown(c)


@register("snk01_dead_letters", sql("""
SELECT key, verr.time, to_json(errors)::VARCHAR AS validation_errors, '1.0' AS validator_version,
  strftime(verr.time + to_minutes(CAST(vraw.g % 90 - 10 AS INTEGER)), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp,
  CASE WHEN vraw.g = 8 THEN '' ELSE key END AS original_uuid,
  strftime(verr.time, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS original_timestamp
FROM verr JOIN vraw ON verr.key = vraw.gpu_uuid AND verr.time = vraw.time WHERE len(errors) > 0""", VALIDATION_CTE))
def snk01_dead_letters(spark, sf):
    t, c = _checked(spark, sf)
    d = validate.dead_letters(c, now=F.col("received_at"))
    return d.select("key", "time", F.to_json(F.col("dead_letter.validation_errors")).alias("validation_errors"),
                    F.col("dead_letter.validator_version").alias("validator_version"),
                    F.col("dead_letter.timestamp").alias("timestamp"),
                    F.get_json_object("dead_letter.original_event", "$.gpu.gpu_uuid").alias("original_uuid"),
                    F.get_json_object("dead_letter.original_event", "$.timestamp").alias("original_timestamp"))


FLAT_DOUBLES = ["gpu_temp", "memory_temp", "power_usage", "memory_utilization", "sm_active", "sm_occupancy",
                "tensor_active", "dram_active", "pcie_tx_bytes_per_sec", "pcie_rx_bytes_per_sec",
                "gpu_utilization", "mem_copy_utilization"]


@register("prj01_enriched_flat_rows", sql(rnd("""
SELECT m.time, m.gpu_uuid, m.hostname, m.pci_bus_id, m.device_index,
  CASE WHEN v.g BETWEEN 0 AND 4 THEN m.gpu_temp + 80.0 ELSE m.gpu_temp END AS gpu_temp,
  m.memory_temp, m.power_usage, m.throttle_reasons, m.fb_used_bytes, m.fb_free_bytes,
  m.fb_used_bytes + m.fb_free_bytes AS fb_total_bytes,
  CAST(m.fb_used_bytes // 1048576 AS DOUBLE) / CAST((m.fb_used_bytes + m.fb_free_bytes) // 1048576 AS DOUBLE) * 100.0
    AS memory_utilization,
  m.ecc_sbe_volatile, m.ecc_dbe_volatile, m.ecc_sbe_aggregate, m.ecc_dbe_aggregate, m.retired_pages_sbe,
  m.retired_pages_dbe, m.sm_active, m.sm_occupancy, m.tensor_active, m.dram_active, m.pcie_tx_bytes_per_sec,
  m.pcie_rx_bytes_per_sec, m.sm_clock_mhz, m.mem_clock_mhz, m.sm_active AS gpu_utilization,
  m.dram_active * 0.8 AS mem_copy_utilization, m.collection_latency_ms, TRUE AS validation_passed,
  a.datacenter AS asset_datacenter, a.model AS asset_model,
  CASE WHEN a.gpu_uuid IS NOT NULL THEN a.rack_id ELSE '' END AS host_rack,
  a.gpu_uuid IS NOT NULL AS asset_metadata_found
FROM gpu_metrics m JOIN verr v ON m.gpu_uuid = v.key AND m.time = v.time
JOIN vraw v2 ON m.gpu_uuid = v2.gpu_uuid AND m.time = v2.time
LEFT JOIN gpu_assets a ON m.gpu_uuid = a.gpu_uuid
WHERE len(v.errors) = 0""".replace("v.g BETWEEN", "v2.g BETWEEN"), FLAT_DOUBLES), VALIDATION_CTE))
def prj01_enriched_flat_rows(spark, sf):
    t, c = _checked(spark, sf)
    ok = validate.valid_events(c, now=F.col("received_at"))
    en = enrich.enrich(ok, t["assets"], now=F.col("received_at"))
    e = F.col("e")
    return finish(enrich.flatten(en, extra=[
        e["asset"]["datacenter"].alias("asset_datacenter"), e["asset"]["model"].alias("asset_model"),
        e["host"]["rack"].alias("host_rack"), e["quality"]["asset_metadata_found"].alias("asset_metadata_found")]))

"""DuckDB SQL text of the telemetry projection, shared by every oracle query.

It mirrors ``fleetscope.sources.driver`` expression for expression (double
literals are cast explicitly so both engines evaluate the same IEEE operations).
"""

from __future__ import annotations

METRICS_CTE = """
ev_k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS kd
  FROM events
),
ev_t AS (
  SELECT *, 45 + 0.4::DOUBLE * kd + 0.1::DOUBLE * least(value, 100.0::DOUBLE) AS t_gpu,
         CAST(1024 + 512 * k AS BIGINT) * 1048576 AS fb_used
  FROM ev_k
),
gpu_metrics AS (
  SELECT
    CAST(ts AS TIMESTAMP) AS time,
    concat('GPU-', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS gpu_uuid,
    concat('host-', CAST(user_id % 10 AS VARCHAR)) AS hostname,
    printf('0000:%02X:00.0', user_id % 8 + 59) AS pci_bus_id,
    CAST(user_id % 8 AS SMALLINT) AS device_index,
    t_gpu AS gpu_temp,
    t_gpu + 5 + event_id % 4 AS memory_temp,
    200 + 0.4::DOUBLE * value AS power_usage,
    CAST(CASE WHEN event_type = 'error' THEN
           CASE event_id % 3 WHEN 0 THEN 64 WHEN 1 THEN 128 ELSE 4 END
         ELSE 0 END AS BIGINT) AS throttle_reasons,
    fb_used AS fb_used_bytes,
    CAST(85899345920 AS BIGINT) - fb_used AS fb_free_bytes,
    CAST(85899345920 AS BIGINT) AS fb_total_bytes,
    10 + 0.8::DOUBLE * kd AS memory_utilization,
    CAST((event_id % 13) * 20 AS INTEGER) AS ecc_sbe_volatile,
    CAST(CASE WHEN event_id % 211 = 0 THEN 1 ELSE 0 END AS INTEGER) AS ecc_dbe_volatile,
    CAST(event_id // 100 AS BIGINT) AS ecc_sbe_aggregate,
    CAST(event_id // 2000 AS BIGINT) AS ecc_dbe_aggregate,
    CAST(user_id % 3 AS INTEGER) AS retired_pages_sbe,
    CAST(CASE WHEN user_id % 17 = 0 THEN 2 ELSE 0 END AS INTEGER) AS retired_pages_dbe,
    kd AS sm_active,
    0.5::DOUBLE * kd AS sm_occupancy,
    CASE WHEN k > 50 THEN 0.9::DOUBLE * kd ELSE 0.0::DOUBLE END AS tensor_active,
    0.7::DOUBLE * kd AS dram_active,
    value * 1000000.0::DOUBLE AS pcie_tx_bytes_per_sec,
    value * 3000000.0::DOUBLE AS pcie_rx_bytes_per_sec,
    CAST(1095 + 3 * k AS INTEGER) AS sm_clock_mhz,
    CAST(1215 + 2 * (event_id % 5) AS INTEGER) AS mem_clock_mhz,
    kd AS gpu_utilization,
    (0.7::DOUBLE * kd) * 0.8::DOUBLE AS mem_copy_utilization,
    CAST(event_id % 50 AS INTEGER) AS collection_latency_ms,
    TRUE AS validation_passed
  FROM ev_t
),
as_of AS (SELECT max(time) AS as_of FROM gpu_metrics),
gpu_assets AS (
  SELECT
    concat('GPU-', lpad(CAST(s_suppkey AS VARCHAR), 6, '0')) AS gpu_uuid,
    CASE s_suppkey % 3 WHEN 0 THEN 'NVIDIA A100-SXM4-80GB' WHEN 1 THEN 'NVIDIA H100-SXM5-80GB'
         ELSE 'NVIDIA A100-SXM4-40GB' END AS model,
    CASE WHEN s_suppkey % 3 = 1 THEN 'Hopper' ELSE 'Ampere' END AS architecture,
    CASE WHEN s_suppkey % 3 = 1 THEN '9.0' ELSE '8.0' END AS compute_capability,
    CAST(CASE WHEN s_suppkey % 3 = 2 THEN 40 ELSE 80 END AS INTEGER) AS memory_gb,
    concat('host-', CAST(s_suppkey % 10 AS VARCHAR)) AS hostname,
    printf('0000:%02X:00.0', s_suppkey % 8 + 59) AS pci_bus_id,
    concat('rack-', CAST(s_suppkey % 8 AS VARCHAR)) AS rack_id,
    concat('cluster-', CAST(s_nationkey % 4 AS VARCHAR)) AS cluster_id,
    r_name AS datacenter,
    n_name AS region,
    DATE '2024-01-31' - CAST(13 * s_suppkey AS INTEGER) - 30 AS purchase_date,
    DATE '2024-01-31' - CAST(13 * s_suppkey AS INTEGER) AS deployment_date,
    CAST((DATE '2024-01-31' - CAST(13 * s_suppkey AS INTEGER)) + INTERVAL 36 MONTH AS DATE) AS warranty_expiry,
    CAST((DATE '2024-01-31' - CAST(13 * s_suppkey AS INTEGER)) + INTERVAL 60 MONTH AS DATE) AS expected_eol,
    CASE s_suppkey % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' ELSE 'bronze' END AS sla_tier,
    CAST(s_suppkey % 5 AS INTEGER) AS priority,
    concat('{"profile": "', CASE s_suppkey % 4 WHEN 0 THEN 'healthy' WHEN 1 THEN 'thermal'
           WHEN 2 THEN 'ecc' ELSE 'aging' END, '"}') AS tags,
    s_name AS notes
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
gpu_datacenter_mapping AS (
  SELECT gpu_uuid, datacenter, rack_id, cluster_id AS cluster_name,
         concat_ws(', ', region, datacenter) AS location
  FROM gpu_assets
)"""


def sql(body: str, extra_ctes: str = "") -> str:
    """Oracle query = shared projection CTEs (+ query CTEs) + body."""
    ctes = METRICS_CTE + ("," + extra_ctes if extra_ctes.strip() else "")
    b = body.lstrip()
    if b[:5].upper() == "WITH ":  # merge the body's own CTEs into the shared list
        return f"WITH {ctes},\n{b[5:]}"
    return f"WITH {ctes}\n{body}"

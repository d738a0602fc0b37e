"""Asset enrichment (JON7) and the sink's flattening to ``gpu_metrics`` rows (PRJ1, PRJ2, PRJ8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.columns import MIB, mib_to_bytes, parse_iso_ts
from fleetscope.operators.ingest import iso_text

ASSET_FIELDS = ["model", "architecture", "compute_capability", "memory_gb", "rack_id", "cluster_id", "datacenter",
                "region", "purchase_date", "deployment_date", "warranty_expiry", "expected_eol", "sla_tier",
                "priority", "tags", "notes"]
ENRICHER_VERSION = "1.0"


def _fill(current: Column, asset_value: Column) -> Column:
    """Keep a non-empty event value, else take the asset's (when the asset has one)."""
    return F.when((F.coalesce(current, F.lit("")) == "") & asset_value.isNotNull() & (asset_value != ""),
                  asset_value).otherwise(current)


def enrich(events: DataFrame, assets: DataFrame, now: Column | None = None, event_col: str = "e") -> DataFrame:
    """Stream-static LEFT join of events to the asset dimension on ``gpu.gpu_uuid``.

    Adds ``asset`` (16 fields, NULL when unknown), fills empty host fields from the
    asset, and stamps ``quality.enrichment_*`` / ``asset_metadata_found``. Events
    without a uuid pass through unchanged. The dimension is size-checked before
    it is broadcast; in a stream it is re-read per micro-batch (``foreachBatch``).
    """
    now = now if now is not None else F.current_timestamp()
    a = assets.select(F.col("gpu_uuid").alias("_a_uuid"), F.col("hostname").alias("_a_host"),
                      F.struct(*[F.col(c).cast("string") if c.endswith("_date") or c in ("warranty_expiry",
                                                                                         "expected_eol")
                                 else F.col(c) for c in ASSET_FIELDS]).alias("_asset"))
    e = F.col(event_col)
    uuid = e["gpu"]["gpu_uuid"]
    j = events.join(a, F.coalesce(uuid, F.lit("")) == F.col("_a_uuid"), "left")
    found = F.col("_a_uuid").isNotNull()
    asset = F.col("_asset")
    host = e["host"]
    new_host = (host.withField("hostname", _fill(host["hostname"], F.col("_a_host")))
                    .withField("rack", _fill(host["rack"], asset["rack_id"]))
                    .withField("cluster", _fill(host["cluster"], asset["cluster_id"]))
                    .withField("datacenter", _fill(host["datacenter"], asset["datacenter"])))
    has_uuid = F.coalesce(uuid, F.lit("")) != ""
    quality = e["quality"]
    stamped = (quality.withField("enrichment_timestamp", F.when(has_uuid, iso_text(now)))
                      .withField("enrichment_version", F.when(has_uuid, F.lit(ENRICHER_VERSION)))
                      .withField("asset_metadata_found", F.when(has_uuid, found)))
    enriched = (e.withField("asset", F.when(found, asset))
                 .withField("host", F.when(found, new_host).otherwise(host))
                 .withField("quality", stamped))
    keep = [c for c in events.columns if c != event_col]
    return j.select(*keep, enriched.alias(event_col))


def flatten(events: DataFrame, event_col: str = "e", extra=()) -> DataFrame:
    """Nested event -> the 31 ``gpu_metrics`` columns, as the sink stores them (PRJ1).

    MiB -> bytes (missing -> 0), MB/s -> bytes/s with the factor 1024*1024,
    ``gpu_utilization`` = SM active, ``mem_copy_utilization`` = DRAM active * 0.8;
    asset, cooling, energy and NVLink fields are not stored (sink parity).
    """
    e = F.col(event_col)
    h, m, p, c = e["metrics"]["health"], e["metrics"]["memory"], e["metrics"]["performance"], e["metrics"]["clocks"]
    return events.select(
        parse_iso_ts(e["timestamp"]).alias("time"),
        e["gpu"]["gpu_uuid"].alias("gpu_uuid"), e["host"]["hostname"].alias("hostname"),
        e["gpu"]["pci_bus_id"].alias("pci_bus_id"), e["gpu"]["device_index"].cast("short").alias("device_index"),
        h["gpu_temp_c"].alias("gpu_temp"), h["memory_temp_c"].alias("memory_temp"),
        h["power_usage_w"].alias("power_usage"), h["throttle_reasons"].alias("throttle_reasons"),
        mib_to_bytes(m["fb_used_mib"]).alias("fb_used_bytes"), mib_to_bytes(m["fb_free_mib"]).alias("fb_free_bytes"),
        mib_to_bytes(m["fb_total_mib"]).alias("fb_total_bytes"), m["utilization_pct"].alias("memory_utilization"),
        m["ecc_sbe_volatile"].alias("ecc_sbe_volatile"), m["ecc_dbe_volatile"].alias("ecc_dbe_volatile"),
        m["ecc_sbe_aggregate"].alias("ecc_sbe_aggregate"), m["ecc_dbe_aggregate"].alias("ecc_dbe_aggregate"),
        m["retired_pages_sbe"].alias("retired_pages_sbe"), m["retired_pages_dbe"].alias("retired_pages_dbe"),
        p["sm_active_pct"].alias("sm_active"), p["sm_occupancy_pct"].alias("sm_occupancy"),
        p["tensor_active_pct"].alias("tensor_active"), p["dram_active_pct"].alias("dram_active"),
        (F.coalesce(p["pcie_tx_mb_per_sec"], F.lit(0.0)) * F.lit(float(MIB))).alias("pcie_tx_bytes_per_sec"),
        (F.coalesce(p["pcie_rx_mb_per_sec"], F.lit(0.0)) * F.lit(float(MIB))).alias("pcie_rx_bytes_per_sec"),
        c["sm_clock_mhz"].alias("sm_clock_mhz"), c["mem_clock_mhz"].alias("mem_clock_mhz"),
        p["sm_active_pct"].alias("gpu_utilization"),
        (F.coalesce(p["dram_active_pct"], F.lit(0.0)) * 0.8).alias("mem_copy_utilization"),
        F.coalesce(e["quality"]["collection_latency_ms"], F.lit(0)).alias("collection_latency_ms"),
        F.lit(True).alias("validation_passed"),
        *extra,
    )

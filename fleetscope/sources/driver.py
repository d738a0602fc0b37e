"""Stand-ins for the fleet tables, derived from the driver's parquet tables.

The driver tables are a generic star schema plus an ``events`` table. The
projections below map them deterministically onto the telemetry model
(``gpu_metrics``), the asset dimension (``gpu_assets``) and price-page texts, so
every operator runs on data whose volume grows with the given tables. The same
projection is written in SQL for the DuckDB oracle (``fleetscope.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Fixed values of the stand-in dimension: model names as the economic tables key
# them, and the anchor date the synthetic deployment dates count back from.
MODEL_A100_80 = "NVIDIA A100-SXM4-80GB"
MODEL_H100_80 = "NVIDIA H100-SXM5-80GB"
MODEL_A100_40 = "NVIDIA A100-SXM4-40GB"
DEPLOY_ANCHOR = "2024-01-31"
FB_TOTAL_MIB = 81920
MIB = 1048576


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pci_bus(index: Column) -> Column:
    return F.format_string("0000:%02X:00.0", index + F.lit(59))


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Project ``events`` onto the 31-column ``gpu_metrics`` row.

    One event = one sample of one device (``user_id`` -> device). ``props.k`` drives
    load-dependent metrics; event type ``error`` carries throttle bits.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    kd = k.cast("double")
    eid = F.col("event_id")
    uid = F.col("user_id")
    gpu_temp = F.lit(45) + F.lit(0.4) * kd + F.lit(0.1) * F.least(F.col("value"), F.lit(100.0))
    fb_used = (F.lit(1024) + F.lit(512) * k).cast("long") * F.lit(MIB)
    return events.select(
        F.col("ts").cast("timestamp").alias("time"),
        F.concat(F.lit("GPU-"), F.lpad(uid.cast("string"), 6, "0")).alias("gpu_uuid"),
        F.concat(F.lit("host-"), (uid % 10).cast("string")).alias("hostname"),
        _pci_bus(uid % 8).alias("pci_bus_id"),
        (uid % 8).cast("short").alias("device_index"),
        gpu_temp.alias("gpu_temp"),
        (gpu_temp + F.lit(5) + (eid % 4)).alias("memory_temp"),
        (F.lit(200) + F.lit(0.4) * F.col("value")).alias("power_usage"),
        F.when(F.col("event_type") == "error",
               F.when(eid % 3 == 0, 64).when(eid % 3 == 1, 128).otherwise(4))
         .otherwise(0).cast("long").alias("throttle_reasons"),
        fb_used.alias("fb_used_bytes"),
        (F.lit(FB_TOTAL_MIB * MIB).cast("long") - fb_used).alias("fb_free_bytes"),
        F.lit(FB_TOTAL_MIB * MIB).cast("long").alias("fb_total_bytes"),
        (F.lit(10) + F.lit(0.8) * kd).alias("memory_utilization"),
        ((eid % 13) * 20).cast("int").alias("ecc_sbe_volatile"),
        F.when(eid % 211 == 0, 1).otherwise(0).cast("int").alias("ecc_dbe_volatile"),
        F.expr("event_id div 100").cast("long").alias("ecc_sbe_aggregate"),
        F.expr("event_id div 2000").cast("long").alias("ecc_dbe_aggregate"),
        (uid % 3).cast("int").alias("retired_pages_sbe"),
        F.when(uid % 17 == 0, 2).otherwise(0).cast("int").alias("retired_pages_dbe"),
        kd.alias("sm_active"),
        (F.lit(0.5) * kd).alias("sm_occupancy"),
        F.when(k > 50, F.lit(0.9) * kd).otherwise(F.lit(0.0)).alias("tensor_active"),
        (F.lit(0.7) * kd).alias("dram_active"),
        (F.col("value") * F.lit(1000000.0)).alias("pcie_tx_bytes_per_sec"),
        (F.col("value") * F.lit(3000000.0)).alias("pcie_rx_bytes_per_sec"),
        (F.lit(1095) + F.lit(3) * k).cast("int").alias("sm_clock_mhz"),
        (F.lit(1215) + F.lit(2) * (eid % 5)).cast("int").alias("mem_clock_mhz"),
        kd.alias("gpu_utilization"),
        ((F.lit(0.7) * kd) * F.lit(0.8)).alias("mem_copy_utilization"),
        (eid % 50).cast("int").alias("collection_latency_ms"),
        F.lit(True).alias("validation_passed"),
    )


def assets_from_suppliers(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """``supplier`` ⋈ ``nation`` ⋈ ``region`` as the ``gpu_assets`` dimension.

    Supplier keys 0..S-1 stand for devices, so devices seen in ``events`` beyond S
    have no asset row and exercise the left joins.
    """
    sk = F.col("s_suppkey")
    m3 = sk % 3
    deploy = F.date_sub(F.lit(DEPLOY_ANCHOR).cast("date"), (sk * 13).cast("int"))
    s = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "inner") \
                .join(region, F.col("n_regionkey") == region.r_regionkey, "inner")
    return s.select(
        F.concat(F.lit("GPU-"), F.lpad(sk.cast("string"), 6, "0")).alias("gpu_uuid"),
        F.when(m3 == 0, MODEL_A100_80).when(m3 == 1, MODEL_H100_80).otherwise(MODEL_A100_40).alias("model"),
        F.when(m3 == 1, "Hopper").otherwise("Ampere").alias("architecture"),
        F.when(m3 == 1, "9.0").otherwise("8.0").alias("compute_capability"),
        F.when(m3 == 2, 40).otherwise(80).cast("int").alias("memory_gb"),
        F.concat(F.lit("host-"), (sk % 10).cast("string")).alias("hostname"),
        _pci_bus(sk % 8).alias("pci_bus_id"),
        F.concat(F.lit("rack-"), (sk % 8).cast("string")).alias("rack_id"),
        F.concat(F.lit("cluster-"), (F.col("s_nationkey") % 4).cast("string")).alias("cluster_id"),
        F.col("r_name").alias("datacenter"),
        F.col("n_name").alias("region"),
        F.date_sub(deploy, 30).alias("purchase_date"),
        deploy.alias("deployment_date"),
        F.add_months(deploy, 36).alias("warranty_expiry"),
        F.add_months(deploy, 60).alias("expected_eol"),
        F.when(m3 == 0, "gold").when(m3 == 1, "silver").otherwise("bronze").alias("sla_tier"),
        (sk % 5).cast("int").alias("priority"),
        F.concat(F.lit('{"profile": "'),
                 F.when(sk % 4 == 0, "healthy").when(sk % 4 == 1, "thermal")
                  .when(sk % 4 == 2, "ecc").otherwise("aging"),
                 F.lit('"}')).alias("tags"),
        F.col("s_name").alias("notes"),
    )


def datacenter_mapping(assets: DataFrame) -> DataFrame:
    """``gpu_datacenter_mapping`` derived from the asset dimension."""
    return assets.select(
        "gpu_uuid", "datacenter", "rack_id",
        F.col("cluster_id").alias("cluster_name"),
        F.concat_ws(", ", "region", "datacenter").alias("location"),
    )


def page_model() -> Column:
    """Model that a part's price page is about: two fifths of the pages quote the models
    that have rules and bounds of their own, the others the part's brand."""
    pk = F.col("p_partkey")
    return F.when(pk % 5 == 1, MODEL_A100_80).when(pk % 5 == 3, MODEL_H100_80).otherwise(F.col("p_brand"))


def price_texts_from_parts(part: DataFrame) -> DataFrame:
    """Price-page texts built from the part list (the driver ``pages`` hold no prices).

    Each part yields a small HTML page quoting a used-market range; the dash style
    cycles through hyphen / en dash / em dash, every seventh page quotes a single
    figure and every eleventh a secondary and a used range, so every branch of the
    extractor and of the models' rules runs.
    """
    pk = F.col("p_partkey")
    lo = F.floor(F.col("p_retailprice") * F.lit(10.0)).cast("long")
    hi = F.floor(F.col("p_retailprice") * F.lit(14.0)).cast("long")
    dash = F.when(pk % 3 == 0, "-").when(pk % 3 == 1, "–").otherwise("—")
    money = lambda c: F.format_number(c, 0)  # noqa: E731  '12,345' style with thousands commas
    body = F.when(pk % 7 == 6,
                  F.concat(F.lit("<p>Listed at $"), money(lo), F.lit(" today.</p>")))\
            .when(pk % 11 == 5, F.concat(F.lit("<div><p>Secondary market $"), money(hi), F.lit("-$"), money(hi + lo),
                                         F.lit("</p><p>Used (good) $"), money(lo), F.lit("-$"), money(hi), F.lit("</p></div>")))\
            .otherwise(F.concat(F.lit("<div><h2>Used market</h2><p>Secondary range: $"), money(lo),
                                dash, F.lit("$"), money(hi), F.lit(" per unit</p></div>")))
    return part.select(
        pk.alias("page_id"),
        page_model().alias("model"),
        F.when(pk % 2 == 0, "used_good").otherwise("used_fair").alias("condition"),
        F.concat(F.lit("<html><body>"), F.col("p_name"), body, F.lit("</body></html>")).alias("html"),
        (F.lit(DEPLOY_ANCHOR).cast("timestamp") + F.make_interval(mins=pk.cast("int"))).alias("fetched_at"),
        F.col("p_retailprice").alias("original_cost_usd"),
    )


def load_fleet(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The fleet tables an operator needs, as lazily-projected DataFrames."""
    events = read_table(spark, sf_dir, "events")
    supplier = read_table(spark, sf_dir, "supplier")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    assets = assets_from_suppliers(supplier, nation, region)
    return {
        "metrics": telemetry_from_events(events),
        "assets": assets,
        "mapping": datacenter_mapping(assets),
        "events": events,
    }


def device_model(device_index) -> Column:
    """Model label of a device in the exposition/event stand-ins (by index parity)."""
    return F.when(device_index % 2 == 0, MODEL_A100_80).otherwise(MODEL_H100_80)


def as_topic(metrics: DataFrame) -> DataFrame:
    """Samples dealt over the shuffle partitions by (device, time), as messages are over a
    topic's partitions. Only the stand-ins for a topic or for scrapes are dealt, always and
    whatever their size; stored telemetry never is."""
    n = int(metrics.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return metrics.repartition(n, "gpu_uuid", "time")


def raw_event_stream(metrics: DataFrame) -> DataFrame:
    """The raw topic as JSON text (``key``, ``value``, ``received_at``, ``time``).

    Events are built from telemetry (PRJ3). A deterministic 1.1 % of them carry
    sensor faults keyed on the sample's microsecond digits ``g``: a temperature
    +80 °C (g 0-4), no ``clocks`` section (g 5-7), an empty uuid (g 8), an SM clock
    of 50 MHz (g 9), SM active 101 % (g 10). ``received_at`` (the validator's
    clock) lags the sample by ((g mod 90) - 10) minutes, so some arrive late
    (> 1 h) and some early (> 5 min ahead).
    """
    from fleetscope.operators.ingest import build_events
    g = F.unix_micros(F.col("time")) % 1000
    ev = build_events(as_topic(metrics), model=device_model(F.col("device_index")))
    e = F.col("e")
    temp = e["metrics"]["health"]["gpu_temp_c"]
    # each fault rewrites one field in place, so the event struct is built once
    e = (e.withField("metrics.health.gpu_temp_c", F.when(g.between(0, 4), temp + 80.0).otherwise(temp))
          .withField("gpu.gpu_uuid", F.when(g == 8, F.lit("")).otherwise(e["gpu"]["gpu_uuid"]))
          .withField("metrics.clocks.sm_clock_mhz",
                     F.when(g == 9, F.lit(50)).otherwise(e["metrics"]["clocks"]["sm_clock_mhz"]))
          .withField("metrics.performance.sm_active_pct",
                     F.when(g == 10, F.lit(101.0)).otherwise(e["metrics"]["performance"]["sm_active_pct"])))
    text = F.to_json(e)
    text = F.when(g.between(5, 7), F.regexp_replace(text, r',"clocks":\{[^}]*\}', "")).otherwise(text)
    lag_min = (g % 90 - 10).cast("int")
    return ev.select(F.col("gpu_uuid").alias("key"), text.alias("value"),
                     (F.col("time") + F.make_interval(mins=lag_min)).alias("received_at"), "time")

"""Event-side projections: exposition-text parsing (SRC1), nested event building
(PRJ3, PRJ4, PRJ6, PRJ7) and the event schema (SRC2).

All row-local: no shuffle except SRC1's grouping of one scrape's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.functions.columns import MIB, decode_throttle, memory_util_pct, pci_bus_id, uuid_gpu_id

EVENT_SCHEMA = T.StructType([
    T.StructField("schema_version", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("collection_timestamp", T.StringType()),
    T.StructField("processing_timestamp", T.StringType()),
    T.StructField("gpu", T.StructType([
        T.StructField("gpu_id", T.StringType()), T.StructField("gpu_uuid", T.StringType()),
        T.StructField("device_index", T.IntegerType()), T.StructField("pci_bus_id", T.StringType()),
        T.StructField("name", T.StringType()), T.StructField("architecture", T.StringType()),
        T.StructField("compute_capability", T.StringType())])),
    T.StructField("host", T.StructType([
        T.StructField("hostname", T.StringType()), T.StructField("cluster", T.StringType()),
        T.StructField("rack", T.StringType()), T.StructField("datacenter", T.StringType())])),
    T.StructField("metrics", T.StructType([
        T.StructField("health", T.StructType([
            T.StructField("gpu_temp_c", T.DoubleType()), T.StructField("memory_temp_c", T.DoubleType()),
            T.StructField("power_usage_w", T.DoubleType()), T.StructField("throttle_reasons", T.LongType()),
            T.StructField("throttle_reasons_decoded", T.ArrayType(T.StringType()))])),
        T.StructField("memory", T.StructType([
            T.StructField("fb_used_mib", T.LongType()), T.StructField("fb_free_mib", T.LongType()),
            T.StructField("fb_total_mib", T.LongType()), T.StructField("utilization_pct", T.DoubleType()),
            T.StructField("ecc_sbe_volatile", T.IntegerType()), T.StructField("ecc_dbe_volatile", T.IntegerType()),
            T.StructField("ecc_sbe_aggregate", T.LongType()), T.StructField("ecc_dbe_aggregate", T.LongType()),
            T.StructField("retired_pages_sbe", T.IntegerType()), T.StructField("retired_pages_dbe", T.IntegerType())])),
        T.StructField("performance", T.StructType([
            T.StructField(n, T.DoubleType()) for n in (
                "sm_active_pct", "sm_occupancy_pct", "tensor_active_pct", "dram_active_pct",
                "pcie_tx_mb_per_sec", "pcie_rx_mb_per_sec", "nvlink_tx_mb_per_sec", "nvlink_rx_mb_per_sec",
                "gpu_utilization_pct", "memory_copy_utilization_pct")])),
        T.StructField("clocks", T.StructType([
            T.StructField("sm_clock_mhz", T.IntegerType()), T.StructField("mem_clock_mhz", T.IntegerType())])),
        T.StructField("cooling", T.StructType([T.StructField("fan_speed_pct", T.DoubleType())])),
        T.StructField("energy", T.StructType([T.StructField("total_energy_consumption_mj", T.LongType())])),
    ])),
    T.StructField("quality", T.StructType([
        T.StructField("collection_latency_ms", T.IntegerType()), T.StructField("stale", T.BooleanType()),
        T.StructField("sample_count", T.IntegerType()), T.StructField("error", T.StringType())])),
])

ISO_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def iso_text(ts: Column) -> Column:
    """``datetime.isoformat()`` of a UTC timestamp (``+00:00`` suffix)."""
    return F.date_format(ts, ISO_FMT)


def build_events(metrics: DataFrame, model: Column | None = None, cluster: Column | None = None,
                 rack: Column | None = None, datacenter: Column | None = None) -> DataFrame:
    """Flat telemetry rows -> nested event struct ``e`` (PRJ3 with PRJ4/PRJ6/PRJ7)."""
    model = model if model is not None else F.lit(None).cast("string")
    empty = F.lit("")
    m = F.coalesce(model, F.lit(""))
    used = (F.col("fb_used_bytes") / F.lit(MIB)).cast("long")
    free = (F.col("fb_free_bytes") / F.lit(MIB)).cast("long")
    ts = iso_text(F.col("time"))
    e = F.struct(
        F.lit("1.0").alias("schema_version"), F.lit("gpu_metric_sample").alias("event_type"),
        ts.alias("timestamp"), ts.alias("collection_timestamp"), ts.alias("processing_timestamp"),
        F.struct(F.coalesce(uuid_gpu_id("gpu_uuid"), F.lit("unknown")).alias("gpu_id"),
                 F.coalesce(F.col("gpu_uuid"), F.lit("unknown")).alias("gpu_uuid"),
                 F.col("device_index").cast("int").alias("device_index"),
                 pci_bus_id(F.col("device_index").cast("int")).alias("pci_bus_id"),
                 F.coalesce(model, F.lit("Unknown GPU")).alias("name"),
                 F.when(m.contains("A100"), "Ampere").when(m.contains("H100"), "Hopper").otherwise("Unknown")
                 .alias("architecture"),
                 F.when(m.contains("A100"), "8.0").when(m.contains("H100"), "9.0").otherwise("0.0")
                 .alias("compute_capability")).alias("gpu"),
        F.struct(F.col("hostname").alias("hostname"),
                 (cluster if cluster is not None else empty).alias("cluster"),
                 (rack if rack is not None else empty).alias("rack"),
                 (datacenter if datacenter is not None else empty).alias("datacenter")).alias("host"),
        F.struct(
            F.struct(F.col("gpu_temp").alias("gpu_temp_c"), F.col("memory_temp").alias("memory_temp_c"),
                     F.col("power_usage").alias("power_usage_w"),
                     F.coalesce(F.col("throttle_reasons"), F.lit(0).cast("long")).alias("throttle_reasons"),
                     decode_throttle("throttle_reasons").alias("throttle_reasons_decoded")).alias("health"),
            F.struct(used.alias("fb_used_mib"), free.alias("fb_free_mib"), (used + free).alias("fb_total_mib"),
                     memory_util_pct(used, free).alias("utilization_pct"),
                     F.col("ecc_sbe_volatile").alias("ecc_sbe_volatile"),
                     F.col("ecc_dbe_volatile").alias("ecc_dbe_volatile"),
                     F.col("ecc_sbe_aggregate").alias("ecc_sbe_aggregate"),
                     F.col("ecc_dbe_aggregate").alias("ecc_dbe_aggregate"),
                     F.col("retired_pages_sbe").alias("retired_pages_sbe"),
                     F.col("retired_pages_dbe").alias("retired_pages_dbe")).alias("memory"),
            F.struct(F.col("sm_active").alias("sm_active_pct"), F.col("sm_occupancy").alias("sm_occupancy_pct"),
                     F.col("tensor_active").alias("tensor_active_pct"), F.col("dram_active").alias("dram_active_pct"),
                     (F.col("pcie_tx_bytes_per_sec") / F.lit(float(MIB))).alias("pcie_tx_mb_per_sec"),
                     (F.col("pcie_rx_bytes_per_sec") / F.lit(float(MIB))).alias("pcie_rx_mb_per_sec"),
                     F.lit(0.0).alias("nvlink_tx_mb_per_sec"), F.lit(0.0).alias("nvlink_rx_mb_per_sec"),
                     F.col("gpu_utilization").alias("gpu_utilization_pct"),
                     F.col("mem_copy_utilization").alias("memory_copy_utilization_pct")).alias("performance"),
            F.struct(F.col("sm_clock_mhz").alias("sm_clock_mhz"), F.col("mem_clock_mhz").alias("mem_clock_mhz"))
            .alias("clocks"),
            F.struct(F.lit(0.0).alias("fan_speed_pct")).alias("cooling"),
            F.struct(F.lit(0).cast("long").alias("total_energy_consumption_mj")).alias("energy"),
        ).alias("metrics"),
        F.struct(F.col("collection_latency_ms").alias("collection_latency_ms"), F.lit(False).alias("stale"),
                 F.lit(1).alias("sample_count"), F.lit(None).cast("string").alias("error")).alias("quality"),
    )
    return metrics.select(F.col("time"), F.col("gpu_uuid"), e.alias("e"))


# Exposition series name -> flat telemetry column (or unit conversion
# of one), for the series that an exporter emits.
EXPOSITION_SERIES = [
    ("DCGM_FI_DEV_GPU_TEMP", "gpu_temp"),
    ("DCGM_FI_DEV_MEMORY_TEMP", "memory_temp"),
    ("DCGM_FI_DEV_POWER_USAGE", "power_usage"),
    ("DCGM_FI_DEV_TOTAL_ENERGY_CONSUMPTION", "CAST(floor(power_usage * 1000.0) AS BIGINT)"),
    ("DCGM_FI_DEV_CLOCK_THROTTLE_REASONS", "throttle_reasons"),
    ("DCGM_FI_DEV_FB_FREE", "fb_free_bytes div 1048576"),
    ("DCGM_FI_DEV_FB_USED", "fb_used_bytes div 1048576"),
    ("DCGM_FI_DEV_ECC_SBE_VOL_TOTAL", "ecc_sbe_volatile"),
    ("DCGM_FI_DEV_ECC_DBE_VOL_TOTAL", "ecc_dbe_volatile"),
    ("DCGM_FI_DEV_ECC_SBE_AGG_TOTAL", "ecc_sbe_aggregate"),
    ("DCGM_FI_DEV_ECC_DBE_AGG_TOTAL", "ecc_dbe_aggregate"),
    ("DCGM_FI_DEV_RETIRED_SBE", "retired_pages_sbe"),
    ("DCGM_FI_DEV_RETIRED_DBE", "retired_pages_dbe"),
    ("DCGM_FI_PROF_SM_ACTIVE", "sm_active"),
    ("DCGM_FI_PROF_SM_OCCUPANCY", "sm_occupancy"),
    ("DCGM_FI_PROF_PIPE_TENSOR_ACTIVE", "tensor_active"),
    ("DCGM_FI_PROF_DRAM_ACTIVE", "dram_active"),
    ("DCGM_FI_PROF_PCIE_TX_BYTES", "CAST(floor(pcie_tx_bytes_per_sec) AS BIGINT)"),
    ("DCGM_FI_PROF_PCIE_RX_BYTES", "CAST(floor(pcie_rx_bytes_per_sec) AS BIGINT)"),
    ("DCGM_FI_DEV_SM_CLOCK", "sm_clock_mhz"),
    ("DCGM_FI_DEV_MEM_CLOCK", "mem_clock_mhz"),
    ("DCGM_FI_DEV_GPU_UTIL", "gpu_utilization"),
    ("DCGM_FI_DEV_MEM_COPY_UTIL", "mem_copy_utilization"),
]


def exposition_lines(metrics: DataFrame, model: Column, stamped: Column | None = None) -> DataFrame:
    """Each telemetry sample as one exporter scrape: ``scrape_id`` (device and sample
    time), ``scraped_at``, ``line_no``, ``line``.

    A scrape has a comment, a line per series (with the optional timestamp where
    ``stamped``), and lines that the parser must skip: one without ``UUID``, one with a
    ``gpu`` label that is not a number, and one whose value is not.
    """
    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("null"))
    index, uuid = F.col("device_index").cast("int"), F.col("gpu_uuid")
    labels = F.concat(F.lit('{gpu="'), text(index), F.lit('",UUID="'), text(uuid), F.lit('",modelName="'), text(model), F.lit('"} '))
    ts_ms = (F.unix_micros(F.col("time")) / 1000).cast("long").cast("string")
    tail = F.concat(F.lit(" "), ts_ms)
    if stamped is not None:
        tail = F.when(stamped, tail).otherwise(F.lit(""))
    metrics = metrics.select("*", labels.alias("_labels"), tail.alias("_tail"))  # once per scrape, not per line
    lines = [F.lit("# HELP DCGM_FI_DEV_GPU_TEMP GPU temperature (in C).")]
    for name, c in EXPOSITION_SERIES:
        lines.append(F.concat(F.lit(name), F.col("_labels"), F.expr(c).cast("string"), F.col("_tail")))
    lines.append(F.concat(F.lit('DCGM_FI_DEV_FAN_SPEED{gpu="'), F.col("device_index").cast("string"), F.lit('"} 0')))
    lines.append(F.concat(F.lit('DCGM_FI_DEV_FAN_SPEED{gpu="none",UUID="'), F.col("gpu_uuid"), F.lit('"} 1')))
    lines.append(F.concat(F.lit('DCGM_FI_DEV_FAN_SPEED{gpu="0",UUID="'), F.col("gpu_uuid"), F.lit('"} n/a')))
    lines.append(F.lit(""))
    return metrics.select(F.concat_ws("@", "gpu_uuid", F.unix_micros("time").cast("string")).alias("scrape_id"),
                          F.col("time").alias("scraped_at"), F.posexplode(F.array(*lines)).alias("line_no", "line"))


# key="value" pairs without blanks around "," and "=" and without either in a value
PLAIN_LABELS = r'^(?:[^\s,="]++="[^,="]*+"(?:,|\z))*+\z'


def _labels(labels: Column, names: list[str]) -> list[Column]:
    """The values of ``names`` in a label text, without outer blanks and quotes (absent: null,
    the last of equal keys wins).

    Plain texts, as exporters write them, are cut at the key itself. Others go through a
    map: blanks around "," and "=" removed, then ``str_to_map``.
    """
    plain = (F.octet_length(labels) < 1000) & labels.rlike(PLAIN_LABELS)
    text = F.concat(F.lit(","), labels)
    norm = F.regexp_replace(labels, r"\s*([,=])\s*", "$1")
    pairs = F.str_to_map(norm, F.lit(","), F.lit("="))

    def value(k: str) -> Column:
        key = F.lit(f',{k}="')
        cut = F.when(F.contains(text, key), F.substring_index(F.substring_index(text, f',{k}="', -1), '"', 1))
        return F.btrim(F.when(plain, cut).otherwise(pairs[k]), F.lit(' "')).alias(k)
    return [value(k) for k in names]


def parse_exposition(lines: DataFrame, line_col: str = "line", order_col: str = "line_no", scrape_col: str = "scrape_id",
                     time_col: str = "scraped_at") -> DataFrame:
    """Exposition text -> one row per (scrape, device) with a metrics map (SRC1).

    Only ``name{labels} value [timestamp]`` lines are read; the timestamp is optional
    and not used where the input names its scrapes: ``scrape_col`` groups the lines and
    ``time_col`` is the scrape's time. Lines without these columns are grouped by
    their timestamp (those that lack one being a single scrape without a time). Blank and ``#`` lines, lines without
    ``UUID``, with a ``gpu`` label that is no integer or without a number as value are
    skipped; the last value of a series wins, and model and index come from the device's
    first line. Groups are a scrape's lines of one device.
    """
    named = scrape_col in lines.columns
    own = (F.col(scrape_col), F.col(time_col)) if named else (F.lit(None).cast("string"), F.lit(None).cast("timestamp"))
    # every text is cut once, in projections below a one-row generator: a filter on them
    # would be moved below them and cut the line again for each of its conditions
    d = lines.where(F.contains(line_col, F.lit("{")) & F.contains(line_col, F.lit("UUID"))).select(
        own[0].alias("_scrape"), own[1].alias("_at"), F.col(order_col).alias("_ord"), F.trim(F.col(line_col)).alias("_ln"))
    ids = ["_scrape", "_at", "_ord", "metric"]
    d = d.select("_scrape", "_at", "_ord", F.substring_index("_ln", "{", 1).alias("metric"),
                 F.substr("_ln", F.instr("_ln", "{") + 1).alias("_after"))  # text after the first "{"
    d = d.select(*ids, F.instr("_after", "}").alias("_close"), "_after")
    d = d.select(*ids, "_close", F.trim(F.substring_index("_after", "}", 1)).alias("_labels"),
                 F.trim(F.substr("_after", F.col("_close") + 1)).alias("_rest"))
    d = d.select(*ids, "_close", "_rest", *_labels(F.col("_labels"), ["UUID", "modelName", "gpu"]))
    index = F.col("gpu")
    first = F.substring_index("_rest", " ", 1)  # the usual case; any white space ends the value
    value = F.coalesce(F.when(F.ascii(first) > 32, first.try_cast("double")),
                       F.regexp_extract("_rest", r"^(\S*)", 1).try_cast("double"))
    read = {"gpu_uuid": F.col("UUID"), "model": F.col("modelName"),
            "device_index": F.when(index.isNull(), F.lit(0)).otherwise(index.try_cast("int")),
            "value": value}
    if not named:
        stamp = F.regexp_extract("_rest", r"^\S*\s+(\S+)", 1).try_cast("long")
        d = d.withColumns({"_scrape": stamp.cast("string"), "_at": F.timestamp_millis(stamp)})
    d = d.select(*ids, F.inline(F.array(F.struct("_close", *[c.alias(n) for n, c in read.items()]))))
    # no "}": the line cannot be split, skip it
    d = d.where((F.col("_close") > 0) & ~F.col("metric").startswith("#") & (F.col("gpu_uuid") != "")
                & F.col("value").isNotNull() & F.col("device_index").isNotNull())
    # one grouping per (scrape, device): entries sorted by (metric, line order) feed
    # map_from_entries, whose last-wins key policy keeps the last value of a series
    return (d.groupBy("_scrape", "gpu_uuid")
            .agg(F.min("_at").alias("time"), F.min_by(F.struct("model", "device_index"), "_ord").alias("_first"),
                 F.map_from_entries(F.transform(
                     F.array_sort(F.collect_list(F.struct("metric", "_ord", "value"))),
                     lambda e: F.struct(e["metric"], e["value"]))).alias("metrics"))
            .select("gpu_uuid", "time", F.col("_first.model").alias("model"),
                    F.col("_first.device_index").alias("device_index"), "metrics"))

"""Fleet, datacenter and rack read-side queries (AGG6-AGG11, AGG15, JON1-JON6,
TOP2/TOP3, SET1, SET6, SRC8, FLT3, FLT4).

Dashboard panels that take one datacenter or one device as a template variable
are generalised to every group at once (``groupBy(datacenter)``), which is the
set-based form of the same SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.columns import round_numeric
from fleetscope.functions.timewin import since, window_rows
from fleetscope.operators.latest import latest_per_key

LATEST_COLS = ["time", "hostname", "gpu_temp", "memory_temp", "power_usage", "throttle_reasons",
               "memory_utilization", "sm_active", "ecc_dbe_volatile", "ecc_sbe_volatile",
               "ecc_sbe_aggregate", "ecc_dbe_aggregate"]


def latest_metrics(metrics: DataFrame, cols=LATEST_COLS, as_of: Column | None = None, lookback: str | None = None) -> DataFrame:
    """``v_latest_gpu_metrics`` (WIN1).

    With ``as_of`` and ``lookback`` only devices seen in that span are listed and only its
    days are read; without, every stored row is.
    """
    rows = metrics if lookback is None else window_rows(metrics, as_of, lookback)
    return latest_per_key(rows, "gpu_uuid", "time", cols)


def recent_metrics(metrics: DataFrame, gpu: str, as_of: Column, window: str = "24 hours") -> DataFrame:
    """One device's samples of the last ``window``, newest first (the API's metrics endpoint)."""
    return window_rows(metrics, as_of, window, ahead=True).where(F.col("gpu_uuid") == gpu).orderBy(F.col("time").desc())


def recent_scores(scores: DataFrame, gpu: str, limit: int = 100) -> DataFrame:
    """One device's newest ``limit`` scores (the API's health endpoint; the limit is its parameter)."""
    return scores.where(F.col("gpu_uuid") == gpu).orderBy(F.col("time").desc()).limit(limit)


def fleet_summary(latest: DataFrame) -> DataFrame:
    """``v_fleet_health_summary`` over the latest row per device (AGG6)."""
    return latest.agg(
        F.count_distinct("gpu_uuid").alias("total_gpus"),
        F.avg("gpu_temp").alias("avg_temp"),
        F.max("gpu_temp").alias("max_temp"),
        F.avg("power_usage").alias("avg_power"),
        F.sum(F.when(F.col("throttle_reasons") > 0, 1).otherwise(0)).alias("throttling_count"),
        F.sum(F.when(F.col("ecc_dbe_volatile") > 0, 1).otherwise(0)).alias("dbe_error_count"),
    )


def param_filter(col: str | Column, value: str | None, all_token: str = "All") -> Column:
    """``('$p' = 'All' OR col = '$p')``: the predicate exists only when a value is chosen (FLT3)."""
    c = F.col(col) if isinstance(col, str) else col
    if value is None or value == all_token:
        return F.lit(True)
    return c == F.lit(value)


def fleet_scalars(metrics: DataFrame, assets: DataFrame, datacenter: str = "All",
                  gpu: str = "All") -> DataFrame:
    """Six fleet-overview scalars on the latest row per device (AGG7 + JON1 + FLT3)."""
    latest = latest_metrics(metrics)
    j = latest.join(assets.select("gpu_uuid", "datacenter"), "gpu_uuid", "left")
    j = j.where(param_filter("datacenter", datacenter) & param_filter("gpu_uuid", gpu))
    return j.agg(
        F.avg("gpu_temp").alias("avg_temp"), F.max("gpu_temp").alias("max_temp"),
        F.sum("power_usage").alias("total_power"), F.avg("sm_active").alias("avg_utilization"),
        F.sum("ecc_sbe_aggregate").alias("total_sbe"), F.sum("ecc_dbe_aggregate").alias("total_dbe"))


def datacenter_scalars(metrics: DataFrame, mapping: DataFrame, as_of: Column,
                       fresh: str = "30 seconds") -> DataFrame:
    """Datacenter-overview scalars for every datacenter (AGG7 + JON5).

    As on the dashboard, the temperature and power panels see only devices whose
    latest row is within ``fresh`` of ``as_of``; utilisation and ECC totals see all.
    """
    latest_all = latest_metrics(metrics, ["time", "gpu_temp", "power_usage", "sm_active",
                                          "ecc_sbe_aggregate", "ecc_dbe_aggregate"])
    latest_fresh = latest_per_key(metrics.where(since("time", as_of, fresh)), "gpu_uuid", "time",
                                  ["gpu_temp", "power_usage"])
    m = mapping.select("gpu_uuid", "datacenter")
    a = (latest_all.join(m, "gpu_uuid", "inner").groupBy("datacenter")
         .agg(F.avg("sm_active").alias("avg_utilization"), F.sum("ecc_sbe_aggregate").alias("total_sbe"),
              F.sum("ecc_dbe_aggregate").alias("total_dbe")))
    f = (latest_fresh.join(m, "gpu_uuid", "inner").groupBy("datacenter")
         .agg(F.avg("gpu_temp").alias("avg_temp"), F.sum("power_usage").alias("total_power")))
    c = mapping.groupBy("datacenter").agg(F.count_distinct("gpu_uuid").alias("total_gpus"))
    return c.join(a, "datacenter", "left").join(f, "datacenter", "left")


def datacenter_gpu_count(mapping: DataFrame) -> DataFrame:
    """Devices per datacenter (AGG8)."""
    return mapping.groupBy("datacenter").agg(F.count_distinct("gpu_uuid").alias("total_gpus"))


def rack_summary(metrics: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rack table: mapping ⟕ latest, COUNT ignores devices without data (AGG9, JON4, PRJ10)."""
    latest = latest_metrics(metrics, ["time", "gpu_temp", "power_usage", "sm_active"])
    j = mapping.select("datacenter", "rack_id", "gpu_uuid").join(latest, "gpu_uuid", "left")
    return (j.groupBy("datacenter", "rack_id")
             .agg(F.count("time").alias("gpu_count"),
                  round_numeric(F.avg("gpu_temp"), 1).alias("avg_temp"),
                  round_numeric(F.sum("power_usage"), 1).alias("total_power"),
                  round_numeric(F.avg("sm_active"), 1).alias("avg_utilization")))


def datacenter_gpu_table(metrics: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per-device table of each datacenter, hottest first (JON3 + TOP2 + PRJ10)."""
    latest = latest_metrics(metrics, ["time", "gpu_temp", "power_usage", "sm_active",
                                      "ecc_sbe_aggregate", "ecc_dbe_aggregate"])
    j = mapping.select("datacenter", "rack_id", "gpu_uuid").join(latest, "gpu_uuid", "inner")
    return (j.select("datacenter", "rack_id", "gpu_uuid",
                     round_numeric("gpu_temp", 1).alias("gpu_temp"),
                     round_numeric("power_usage", 1).alias("power_usage"),
                     round_numeric("sm_active", 1).alias("utilization"),
                     F.col("ecc_sbe_aggregate").alias("sbe_errors"),
                     F.col("ecc_dbe_aggregate").alias("dbe_errors"))
             .orderBy(F.col("datacenter"), F.col("gpu_temp").desc_nulls_first()))


def status_table(metrics: DataFrame, assets: DataFrame, datacenter: str = "All",
                 gpu: str = "All") -> DataFrame:
    """Fleet status table: latest ⟕ assets, hottest first, NULLs first as in PostgreSQL (TOP2 + JON1)."""
    latest = latest_metrics(metrics, ["time", "gpu_temp", "memory_temp", "power_usage", "sm_active",
                                      "ecc_sbe_aggregate", "ecc_dbe_aggregate"])
    j = latest.join(assets.select("gpu_uuid", "datacenter"), "gpu_uuid", "left")
    j = j.where(param_filter("datacenter", datacenter) & param_filter("gpu_uuid", gpu))
    return (j.select("gpu_uuid", "datacenter",
                     round_numeric("gpu_temp", 1).alias("gpu_temp"),
                     round_numeric("memory_temp", 1).alias("memory_temp"),
                     round_numeric("power_usage", 1).alias("power_usage"),
                     round_numeric("sm_active", 1).alias("utilization"),
                     F.col("ecc_sbe_aggregate").alias("sbe_errors"),
                     F.col("ecc_dbe_aggregate").alias("dbe_errors"))
             .orderBy(F.col("gpu_temp").desc_nulls_first()))


def gpu_stats(metrics: DataFrame, as_of: Column, window: str = "24 hours") -> DataFrame:
    """Per-device statistics over the last ``window`` for all devices (AGG10)."""
    return (window_rows(metrics, as_of, window, ahead=True).groupBy("gpu_uuid")
            .agg(F.count(F.lit(1)).alias("sample_count"), F.avg("gpu_temp").alias("avg_temp"),
                 F.min("gpu_temp").alias("min_temp"), F.max("gpu_temp").alias("max_temp"),
                 F.avg("power_usage").alias("avg_power"), F.max("power_usage").alias("max_power"),
                 F.avg("sm_active").alias("avg_utilization"),
                 F.sum(F.when(F.col("throttle_reasons") > 0, 1).otherwise(0)).alias("throttle_events"),
                 F.sum(F.when(F.col("ecc_dbe_volatile") > 0, 1).otherwise(0)).alias("dbe_error_events")))


def list_gpus(metrics: DataFrame, assets: DataFrame, as_of: Column, window: str = "24 hours") -> DataFrame:
    """Devices with data in ``window``: host, model, last_seen (AGG11 + JON1)."""
    recent = (window_rows(metrics, as_of, window, ahead=True).select("gpu_uuid", "hostname", "time")
              .join(assets.select("gpu_uuid", "model"), "gpu_uuid", "left"))
    return (recent.groupBy("gpu_uuid", "hostname", "model").agg(F.max("time").alias("last_seen"))
            .orderBy("gpu_uuid"))


def active_devices(metrics: DataFrame, as_of: Column, window: str = "1 hour", strict: bool = True) -> DataFrame:
    """Devices seen within ``window`` of ``as_of`` (FLT4), for semi joins."""
    return window_rows(metrics, as_of, window, strict, ahead=True).select("gpu_uuid").distinct()


def datacenter_racks(assets: DataFrame) -> DataFrame:
    """Devices and distinct racks per datacenter, racks as sorted text (AGG15)."""
    return (assets.groupBy("datacenter")
            .agg(F.count(F.lit(1)).alias("gpu_count"),
                 F.array_join(F.array_sort(F.collect_set("rack_id")), ", ").alias("racks")))


def dropdown_values(df: DataFrame, col: str, with_all: bool = True) -> DataFrame:
    """``SELECT 'All' UNION SELECT DISTINCT col ... ORDER BY 1`` (SET1, SRC8)."""
    vals = df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull())
    if with_all:
        vals = vals.unionByName(df.sparkSession.range(1).select(F.lit("All").alias("value")))
    return vals.distinct().orderBy("value")


def long_series(metrics: DataFrame, assets: DataFrame, value_col: str, start=None, end=None,
                datacenter: str = "All", gpu: str = "All") -> DataFrame:
    """``(time, metric=device, value)`` comparison series (SET6 long form, FLT2)."""
    m = metrics.select("time", "gpu_uuid", value_col)
    if start is not None:
        m = m.where(F.col("time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        m = m.where(F.col("time") <= F.lit(end).cast("timestamp"))
    j = m.join(assets.select("gpu_uuid", "datacenter"), "gpu_uuid", "left")
    j = j.where(param_filter("datacenter", datacenter) & param_filter("gpu_uuid", gpu))
    return j.select("time", F.col("gpu_uuid").alias("metric"), F.col(value_col).alias("value"))


def wide_series(long_df: DataFrame, metrics_list: list[str], every: str = "1 hour") -> DataFrame:
    """Long -> wide: one column for each device named in ``metrics_list``, bucketed (SET6 pivot)."""
    from fleetscope.operators.rollups import bucket
    chosen = long_df.where(F.col("metric").isin(metrics_list))
    return chosen.groupBy(bucket("time", every).alias("time")).pivot("metric", metrics_list).agg(F.avg("value"))

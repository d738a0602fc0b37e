"""Five-dimension health scoring for the whole fleet in one job (ANA1, WIN2-WIN4).

Raw rows are read once into partials per (device, bucket); every dimension, the
head/tail means and the gap count are combined from them, so no device's history
is ever gathered in one place, and overlapping windows share one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.columns import (BIT_HW_POWER_BRAKE, BIT_HW_THERMAL, BIT_SW_POWER_CAP, bit_set,
                                          clamp, health_grade)
from fleetscope.functions.timewin import as_of_col, interval, interval_seconds, window_rows
from fleetscope.operators.partials import bucket_partials, combine, combined_moments, mean, moment_aggs, std

# Dimension weights of the overall score.
WEIGHTS = {"memory": 0.30, "thermal": 0.25, "performance": 0.20, "power": 0.15, "reliability": 0.10}
HEAD_TAIL = 24
SCORING_VERSION = "1.0"


def round_half_up(c: Column, n: int) -> Column:
    """Round on the decimal value, half away from zero (same in DuckDB via DECIMAL)."""
    return F.round(c.cast("decimal(38,12)"), n).cast("double")


def _memory(s) -> Column:
    dbe, sbe, ret = (F.coalesce(s[c], F.lit(0)) for c in ("l_dbe", "l_sbe", "l_ret"))
    score = F.lit(100.0)
    score = score - F.when(dbe > 0, F.least(F.lit(50.0), dbe * 10.0)).otherwise(0.0)
    score = score - F.when(sbe > 100, F.least(F.lit(20.0), (sbe - 100) / 100.0 * 20.0)).otherwise(0.0)
    score = score - F.when(ret > 0, F.least(F.lit(30.0), ret * 5.0)).otherwise(0.0)
    k = F.least(F.lit(HEAD_TAIL), s["n"]).cast("double")
    base = F.coalesce(s["head_sum"], F.lit(0.0)) / k
    recent = F.coalesce(s["tail_sum"], F.lit(0.0)) / k
    degr = F.try_divide(base - recent, base)
    score = score - F.when((s["n"] > 1) & (base > 0) & (degr > 0.1), degr * 100.0).otherwise(0.0)
    return clamp(score)


def _thermal(s) -> Column:
    avg, mx, sd = s["temp_avg"], s["temp_max"], s["temp_std"]
    score = F.lit(100.0)
    score = score - (F.when(avg > 85, (avg - 85) * 2.0).when(avg > 75, avg - 75)
                     .when(avg < 30, (30 - avg) * 0.5).otherwise(0.0))
    score = score - F.when(mx > 95, (mx - 95) * 3.0).otherwise(0.0)
    score = score - F.when((s["temp_n"] > 1) & (sd > 10), (sd - 10) * 0.5).otherwise(0.0)
    pct = s["throttle_rows"] / s["n"] * 100.0
    score = score - F.when(pct > 5, pct).otherwise(0.0)
    score = score - F.when(s["hw_thermal_rows"] > 0, 20.0).otherwise(0.0)
    return F.when(s["temp_n"] == 0, F.lit(0.0)).otherwise(clamp(score))


def _performance(s) -> Column:
    pen = F.when((s["occ_n"] > 0) & (s["sm_avg"] > 10) & (s["occ_avg"] < 30), (30 - s["occ_avg"]) * 0.5)
    return F.when(s["sm_n"] == 0, F.lit(100.0)).otherwise(clamp(F.lit(100.0) - F.coalesce(pen, F.lit(0.0))))


def _power(s) -> Column:
    cv = F.try_divide(s["pw_std"], s["pw_avg"])
    score = F.lit(100.0)
    score = score - F.when((s["pw_n"] > 1) & (s["pw_avg"] > 0) & (cv > 0.2), (cv - 0.2) * 100.0).otherwise(0.0)
    score = score - F.when(s["power_brake_rows"] > 0, 15.0).otherwise(0.0)
    score = score - F.when(s["sw_cap_rows"] > s["n"] * 0.5, 10.0).otherwise(0.0)
    return F.when(s["pw_n"] == 0, F.lit(100.0)).otherwise(clamp(score))


def _reliability(s, lookback_days: float, sample_seconds: float) -> Column:
    expected = lookback_days * 86400.0 / sample_seconds
    comp = s["n"] / F.lit(expected)
    score = F.lit(100.0) - F.when(comp < 0.95, (F.lit(0.95) - comp) * 100.0).otherwise(0.0)
    score = score - F.when(s["n"] > 1, F.coalesce(s["gap_count"], F.lit(0)) * 5.0).otherwise(0.0)
    return clamp(score)


# the columns whose mean, deviation and extremes the dimensions read
MOMENTS = {"temp": "gpu_temp", "sm": "sm_active", "occ": "sm_occupancy", "pw": "power_usage"}
COUNTS = ("throttle_rows", "hw_thermal_rows", "power_brake_rows", "sw_cap_rows")


def health_partials(rows: DataFrame, as_of: Column, gap_seconds: float, bucket: str) -> DataFrame:
    """Partials per (device, bucket) from which any window's statistics are combined."""
    thr = F.coalesce(F.col("throttle_reasons"), F.lit(0))
    aggs = [
        F.max_by(F.struct(F.col("ecc_dbe_volatile").alias("d"), F.col("ecc_sbe_volatile").alias("s"),
                          F.col("retired_pages_dbe").alias("r")), F.col("time")).alias("_last"),
        F.count_if(thr > 0).alias("throttle_rows"),
        F.count_if(bit_set("throttle_reasons", BIT_HW_THERMAL)).alias("hw_thermal_rows"),
        F.count_if(bit_set("throttle_reasons", BIT_HW_POWER_BRAKE)).alias("power_brake_rows"),
        F.count_if(bit_set("throttle_reasons", BIT_SW_POWER_CAP)).alias("sw_cap_rows"),
        *moment_aggs(MOMENTS)]
    cols = ["gpu_uuid", "time", "throttle_reasons", "ecc_dbe_volatile", "ecc_sbe_volatile", "retired_pages_dbe", "dram_active",
            *MOMENTS.values()]
    return bucket_partials(rows.select(*cols), as_of, bucket, aggs, gap_seconds, edge=F.coalesce(F.col("dram_active"), F.lit(0.0)))


def device_stats(partials: DataFrame, gap_seconds: float, keys=("gpu_uuid",)) -> DataFrame:
    """Statistics every dimension reads, combined from a window's partials."""
    aggs = [F.max_by("_last", "last_us").alias("_last"), *[F.sum(c).alias(c) for c in COUNTS], *combined_moments(MOMENTS)]
    s = combine(partials, aggs, keys, gap_seconds, edge=True)
    return s.select(*keys, "n", "last_us", "gap_count", "head_sum", "tail_sum", *COUNTS,
                    F.col("temp__n").alias("temp_n"), mean("temp").alias("temp_avg"), F.col("temp__hi").alias("temp_max"),
                    std("temp", False).alias("temp_std"), F.col("sm__n").alias("sm_n"), mean("sm").alias("sm_avg"),
                    F.col("occ__n").alias("occ_n"), mean("occ").alias("occ_avg"), F.col("pw__n").alias("pw_n"),
                    mean("pw").alias("pw_avg"), std("pw", False).alias("pw_std"),
                    F.col("_last.d").alias("l_dbe"), F.col("_last.s").alias("l_sbe"), F.col("_last.r").alias("l_ret"))


def health_scores(metrics: DataFrame, as_of=None, lookback_days: float = 7, active: str = "1 hour",
                  gap_seconds: float = 300, sample_seconds: float = 10,
                  gap_bucket: str = "1 hour") -> DataFrame:
    """One ``gpu_health_scores`` row per device active within ``active`` of ``as_of``.

    Window: ``as_of - lookback_days < time <= as_of``. The grade is taken from the
    unrounded overall score; scores are rounded to one decimal last.
    """
    a = as_of_col(metrics, as_of)
    lookback = f"{int(lookback_days * 86400)} seconds"
    rows = window_rows(metrics, a, lookback)
    s = device_stats(health_partials(rows, a, gap_seconds, gap_bucket), gap_seconds)
    live = F.col("last_us") > F.unix_micros(a - interval(active))
    if interval_seconds(active) <= lookback_days * 86400:
        s = s.where(live)  # an active device has rows in the window
    else:
        s = window_rows(metrics, a, active).select("gpu_uuid").distinct().join(s, "gpu_uuid", "left")
    return score_rows(s, a, lookback_days, sample_seconds)


def score_rows(s: DataFrame, a: Column, lookback_days: float, sample_seconds: float) -> DataFrame:
    """``gpu_health_scores`` rows from ``device_stats``; a NULL ``n`` means no data."""
    mem, th, perf, pw = _memory(s), _thermal(s), _performance(s), _power(s)
    rel = _reliability(s, lookback_days, sample_seconds)
    dims = s.select(a.alias("_time"), "gpu_uuid", "n", "temp_n", "temp_avg", "hw_thermal_rows", "l_dbe", "l_sbe", "l_ret",
                    mem.alias("m"), th.alias("t"), perf.alias("p"), pw.alias("w"), rel.alias("r"))
    overall = (F.col("m") * WEIGHTS["memory"] + F.col("t") * WEIGHTS["thermal"] + F.col("p") * WEIGHTS["performance"]
               + F.col("w") * WEIGHTS["power"] + F.col("r") * WEIGHTS["reliability"])
    factors = F.array_compact(F.array(
        F.when(F.coalesce("l_dbe", F.lit(0)) > 0, "uncorrectable_ecc_errors"),
        F.when(F.coalesce("l_sbe", F.lit(0)) > 100, "high_correctable_ecc_errors"),
        F.when((F.col("temp_n") > 0) & (F.col("temp_avg") > 80), "elevated_temperature"),
        F.when(F.col("hw_thermal_rows") > 0, "thermal_throttling"),
        F.when(F.coalesce("l_ret", F.lit(0)) > 0, "retired_memory_pages"),
        F.when(F.col("m") < 70, "memory_degradation"),
        F.when(F.col("t") < 70, "thermal_issues"),
        F.when(F.col("p") < 70, "performance_degradation"),
    ))
    nodata = F.col("n").isNull()
    zero = F.lit(0.0)
    return dims.select(
        F.col("_time").alias("time"), "gpu_uuid",
        F.when(nodata, zero).otherwise(round_half_up(overall, 1)).alias("overall_score"),
        F.when(nodata, F.lit("unknown")).otherwise(health_grade(overall)).alias("health_grade"),
        F.when(nodata, zero).otherwise(round_half_up(F.col("m"), 1)).alias("memory_health"),
        F.when(nodata, zero).otherwise(round_half_up(F.col("t"), 1)).alias("thermal_health"),
        F.when(nodata, zero).otherwise(round_half_up(F.col("p"), 1)).alias("performance_health"),
        F.when(nodata, zero).otherwise(round_half_up(F.col("w"), 1)).alias("power_health"),
        F.when(nodata, zero).otherwise(round_half_up(F.col("r"), 1)).alias("reliability_health"),
        F.lit(None).cast("double").alias("score_delta_7d"),
        F.lit(None).cast("double").alias("score_delta_30d"),
        F.lit(None).cast("double").alias("degradation_rate"),
        F.when(nodata, F.array(F.lit("no_data"))).otherwise(factors).alias("degradation_factors"),
        F.lit(SCORING_VERSION).alias("scoring_version"),
    )


def score_history(metrics: DataFrame, as_of=None, runs: int = 4, every_days: int = 7, lookback_days: int = 7, active: str = "1 hour",
                  gap_seconds: float = 300, sample_seconds: float = 10, bucket: str = "1 day") -> DataFrame:
    """Scores of ``runs`` scoring runs, ``every_days`` apart, from one pass over the rows.

    A bucket's partial is copied to every run whose window holds it (at most
    lookback / every + 1 copies of a row per device and bucket). ``lookback_days``,
    ``every_days`` and ``active`` must be whole buckets.
    """
    width = interval_seconds(bucket)
    per_run, look, act = every_days * 86400 / width, lookback_days * 86400 / width, interval_seconds(active) / width
    if any(x != int(x) for x in (per_run, look, act)) or act > look:
        raise ValueError("the run step, lookback and active span must be whole buckets, active within lookback")
    a = as_of_col(metrics, as_of)
    span = int((runs - 1) * every_days * 86400 + lookback_days * 86400)
    parts = health_partials(window_rows(metrics, a, f"{span} seconds"), a, gap_seconds, bucket)
    of = F.filter(F.sequence(F.lit(0), F.lit(runs - 1)),
                  lambda r: (F.col("_b") >= r * int(per_run)) & (F.col("_b") < r * int(per_run) + int(look)))
    s = device_stats(parts.withColumn("run", F.explode(of)), gap_seconds, ("run", "gpu_uuid"))
    at = a - F.make_interval(days=F.col("run") * every_days)
    s = s.where(F.col("last_us") > F.unix_micros(at - interval(active))).withColumn("_at", at)
    return score_rows(s, F.col("_at"), lookback_days, sample_seconds)


def score_deltas(scores: DataFrame, key: str = "gpu_uuid", time_col: str = "time") -> DataFrame:
    """Fill ``score_delta_7d/30d`` and ``degradation_rate`` from the score history (JON14).

    Range windows over (device, epoch seconds) do the as-of lookups: the frame
    ``(-inf, t - 7 d]`` ends at the last score at or before a week earlier, and
    ``[t - 30 d, t]`` feeds a per-day regression slope. The windows hold one
    device's score history (a few rows per scoring run), never raw telemetry, and
    no pairs are materialised.
    """
    from pyspark.sql import Window
    sec = F.unix_seconds(F.col(time_col).cast("timestamp"))
    d = scores.withColumn("_sec", sec)
    w = Window.partitionBy(key).orderBy("_sec")
    wk, mo = 7 * 86400, 30 * 86400
    prev7 = F.last("overall_score").over(w.rangeBetween(Window.unboundedPreceding, -wk))
    prev30 = F.last("overall_score").over(w.rangeBetween(Window.unboundedPreceding, -mo))
    rate = F.regr_slope(F.col("overall_score"), F.col("_sec") / 86400.0).over(w.rangeBetween(-mo, 0))
    return (d.withColumn("score_delta_7d", F.col("overall_score") - prev7)
             .withColumn("score_delta_30d", F.col("overall_score") - prev30)
             .withColumn("degradation_rate", rate)
             .drop("_sec"))

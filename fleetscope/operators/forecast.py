"""Linear forecasts and reshapes (ANA7, AGG18, SET2, SET4, SET5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.timewin import window_rows
from fleetscope.operators.latest import latest_per_key


def slope_per_unit(df: DataFrame, value_col: str, as_of: Column, unit_seconds: float, window: str,
                   key: str = "gpu_uuid", time_col: str = "time") -> DataFrame:
    """``regr_slope(value, epoch) * unit`` per key over ``time > as_of - window`` (AGG18).

    x is centred on ``as_of`` and expressed in ``unit_seconds``: the same slope,
    without the cancellation error of raw epoch seconds.
    """
    x = (F.unix_micros(F.col(time_col)) - F.unix_micros(as_of)) / F.lit(unit_seconds * 1e6)
    return (window_rows(df, as_of, window, time_col=time_col).groupBy(key)
              .agg(F.regr_slope(F.col(value_col), x).alias("slope"),
                   F.stddev_samp(value_col).alias("volatility")))


def linear_forecast(df: DataFrame, value_col: str, as_of: Column, steps: int, unit_seconds: float,
                    window: str, horizon_seconds: float | None = None, key: str = "gpu_uuid",
                    time_col: str = "time") -> DataFrame:
    """Last value + slope * k for k = 0..steps (ANA7), for every key at once.

    latest (one row per key) LEFT JOIN trend (one row per key), then
    ``explode(sequence(0, steps))`` — the SQL's cross join with
    ``generate_series`` becomes a per-key generator (SET4). With
    ``horizon_seconds`` rows beyond ``as_of + horizon`` are dropped.
    """
    last = latest_per_key(df.where(F.col(time_col) <= as_of), key, time_col, [value_col])
    trend = slope_per_unit(df, value_col, as_of, unit_seconds, window, key, time_col)
    j = last.join(trend, key, "left").select(key, time_col, value_col, "slope",
                                              F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    t = F.col(time_col) + F.make_interval(secs=(F.col("step") * F.lit(int(unit_seconds))).cast("decimal(18,6)"))
    out = j.select(key, t.alias("time"), "step",
                   (F.col(value_col) + F.col("slope") * F.col("step")).alias("predicted"))
    if horizon_seconds is not None:
        out = out.where(F.col("time") <= as_of + F.make_interval(secs=F.lit(int(horizon_seconds))))
    return out


def components_long(latest_scores: DataFrame, baseline: float = 85.0) -> DataFrame:
    """Five health dimensions, wide -> long, with a constant baseline (SET2)."""
    pairs = [("Thermal", "thermal_health"), ("Memory", "memory_health"), ("Performance", "performance_health"),
             ("Power", "power_health"), ("Reliability", "reliability_health")]
    stack = ", ".join(f"'{name}', {col}" for name, col in pairs)
    return latest_scores.selectExpr("gpu_uuid", f"stack({len(pairs)}, {stack}) AS (component, current_score)") \
                        .withColumn("baseline", F.lit(baseline))


def replicate_to(df: DataFrame, target_rows: int, current_rows: int) -> DataFrame:
    """Repeat rows ``ceil(target / current)`` times (SET5), as the trainer pads small sets,
    with ``copy_no`` from 1.

    ``current_rows`` is the known size of ``df`` (the caller's count of a small
    training frame); each row is expanded by a generator, no self-join.
    """
    k = max(1, -(-target_rows // max(1, current_rows)))
    return df.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("copy_no"))

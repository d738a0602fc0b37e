"""Operators that appear only in the reference's design documents (tag [D]):
rolling and smoothing windows, gap lists, spike detection, interpolation,
distributions, risk scores, fleet averages and outcome tracking
(WIN6-WIN14, AGG33-AGG37, JON12, JON13, JON15, ANA10, ANA11).

Windows over raw rows never partition by device alone: row-based neighbours come
from the ordered scan (``operators/scan.py``); range windows
replicate a halo of the previous ``window`` into each time bucket, so each group is
bounded by rate x (bucket + window).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.timewin import window_rows
from fleetscope.operators.asof import asof_join
from fleetscope.operators.rollups import bucket_percentile
from fleetscope.operators.scan import with_neighbours

# 5-point quadratic (Savitzky-Golay) weights and divisor.
SAVGOL_WEIGHTS = [-3, 12, 17, 12, -3]
SAVGOL_NORM = 35.0
# Risk-score components (weight, scale) and level bands.
RISK_LEVELS = [(25, "low"), (50, "medium"), (75, "high"), (100, "critical")]


def moving_average(df: DataFrame, value_col: str, n: int = 3, key: str = "gpu_uuid", time_col: str = "time") -> DataFrame:
    """Mean of the current and previous ``n - 1`` samples; the first ``n - 1`` rows are dropped (WIN10)."""
    d = with_neighbours(df.select(key, time_col, value_col), [value_col], n - 1, 0, key, time_col)
    total = F.col(value_col)
    for k in range(n - 1, 0, -1):
        total = total + F.col(f"{value_col}_m{k}")
    return d.where(F.col("row_index") >= n - 1).select(key, time_col, "row_index", (total / float(n)).alias("moving_avg"))


def savgol5(df: DataFrame, value_col: str, key: str = "gpu_uuid", time_col: str = "time") -> DataFrame:
    """5-point quadratic smoothing; edge rows (missing neighbours) are NULL (WIN12)."""
    d = with_neighbours(df.select(key, time_col, value_col), [value_col], 2, 2, key, time_col)
    cols = [f"{value_col}_m2", f"{value_col}_m1", value_col, f"{value_col}_p1", f"{value_col}_p2"]
    s = None
    for w, c in zip(SAVGOL_WEIGHTS, cols):
        term = F.col(c) * float(w)
        s = term if s is None else s + term
    return d.select(key, time_col, "row_index", (s / SAVGOL_NORM).alias("smoothed"))


def second_derivative(df: DataFrame, value_col: str, key: str = "gpu_uuid", time_col: str = "time") -> DataFrame:
    """Change of the change between successive samples: x[i] - 2 x[i-1] + x[i-2] (AGG36)."""
    d = with_neighbours(df.select(key, time_col, value_col), [value_col], 2, 0, key, time_col)
    second = F.col(value_col) - 2.0 * F.col(f"{value_col}_m1") + F.col(f"{value_col}_m2")
    return d.select(key, time_col, "row_index", second.alias("second_derivative"))


def _window_extreme(x: np.ndarray, lo: np.ndarray, better) -> np.ndarray:
    """``better`` of x[lo[i] .. i] for each i, from tables over runs of 2, 4, 8, ... values."""
    size = np.arange(len(x)) - lo + 1
    level = np.floor(np.log2(size)).astype(int)
    out, table, width = np.empty_like(x), x.copy(), 1
    for k in range(int(level.max()) + 1 if len(x) else 0):
        at = np.flatnonzero(level == k)  # two runs of length 2**k cover the window
        out[at] = better(table[at - width + 1], table[lo[at]])
        grown = table.copy()  # table[i]: best of the run that ends (and, shifted, begins) there
        if len(x) > width:
            grown[:-width] = better(table[:-width], table[width:])
        table, width = grown, width * 2
    return out


def _rolling(key: str, time_col: str, value_col: str, window_us: int):
    """Arrow batches sorted by (key, bucket, time) -> rows with their window's statistics.

    Vectorised over all groups of a batch: prefix sums of centred values give mean and
    deviation, run tables the extremes. A group that goes on in the next batch is carried over.
    """
    def stats(t: pa.Table) -> pa.Table:
        us, group = t.column("_s").to_numpy(), t.column("_g").to_numpy()
        x = t.column(value_col).cast(pa.float64()).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        which = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
        base = us.min()
        span = int(us.max() - base) + window_us + 1
        line = which * span + (us - base)  # one ascending axis for all groups
        lo = np.maximum(np.searchsorted(line, line - window_us, "left"), start[which])
        hi = np.searchsorted(line, line, "right")  # peers with the same time count too
        ok = ~np.isnan(x)
        filled = np.where(ok, x, 0.0)
        centre = (np.add.reduceat(filled, start) / np.maximum(np.add.reduceat(ok.astype(np.int64), start), 1))[which]
        c = np.where(ok, x - centre, 0.0)
        total = lambda v: np.concatenate([[0], np.cumsum(v)])
        n, s, q = total(ok), total(c), total(c * c)
        n, s, q = n[hi] - n[lo], s[hi] - s[lo], q[hi] - q[lo]
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(n > 0, centre + s / n, np.nan)
            std = np.where(n > 1, np.sqrt(np.maximum(q - s * s / n, 0) / (n - 1)), np.nan)
        last = hi - 1
        big = _window_extreme(np.where(ok, x, -np.inf), lo, np.maximum)
        small = _window_extreme(np.where(ok, x, np.inf), lo, np.minimum)
        # rows with equal times share the window that ends at the last of them
        same = last != np.arange(len(last))
        if same.any():
            both = np.arange(len(last))[same]
            big[both] = [np.where(ok[a:z], x[a:z], -np.inf).max() for a, z in zip(lo[both], hi[both])]
            small[both] = [np.where(ok[a:z], x[a:z], np.inf).min() for a, z in zip(lo[both], hi[both])]
        flat = np.where(big == small, 0.0, std)
        std = np.where(n > 1, flat, np.nan)
        nulled = lambda v: pa.array(v, pa.float64(), mask=~np.isfinite(v))
        home = t.column("_home").to_numpy() == t.column("_b").to_numpy()
        out = pa.table({key: t.column(key), time_col: t.column(time_col), value_col: t.column(value_col), "roll_mean": nulled(mean),
                        "roll_std": nulled(std), "roll_max": nulled(big), "roll_min": nulled(small), "roll_n": pa.array(n, pa.int64())})
        return out.filter(pa.array(home))

    def run(batches):
        carry = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if carry is None else pa.concat_tables([carry, t])
            group = t.column("_g").to_numpy()
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if len(group) and (group != group[-1]).any() else 0
            carry = t.slice(cut)
            if cut:
                yield from stats(t.slice(0, cut)).to_batches()
        if carry is not None and carry.num_rows:
            yield from stats(carry).to_batches()
    return run


def rolling_stats(df: DataFrame, value_col: str, window_seconds: int, key: str = "gpu_uuid",
                  time_col: str = "time", bucket_seconds: int | None = None) -> DataFrame:
    """Mean / sample std / max / min over ``[t - window, t]`` for every row (WIN8, WIN13).

    Rows are assigned to fixed time buckets; each row is also copied as a halo
    into every later bucket whose rows can see it (t within ``window`` of the
    bucket start). One shuffle by (device, bucket), then prefix sums within each
    group: exact, linear in the rows, and bounded per group by rate x (bucket + window).
    """
    b = (bucket_seconds or max(86400, window_seconds)) * 1_000_000
    wu = window_seconds * 1_000_000
    us = F.unix_micros(F.col(time_col))
    home = F.floor(us / b).cast("long")
    last_b = F.floor((us + wu) / b).cast("long")
    d = df.select(key, time_col, value_col, us.alias("_s"), home.alias("_home"),
                  F.explode(F.sequence(home, last_b)).alias("_b")).withColumn("_g", F.xxhash64(key, "_b"))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    schema = (f"{key} {kinds[key]}, {time_col} {kinds[time_col]}, {value_col} {kinds[value_col]}, roll_mean double, roll_std double, "
              "roll_max double, roll_min double, roll_n long")
    return d.repartition(key, "_b").sortWithinPartitions("_g", "_s").mapInArrow(_rolling(key, time_col, value_col, wu), schema)


def sustained_condition(df: DataFrame, value_col: str, threshold: float, window_seconds: int = 300,
                        **kw) -> DataFrame:
    """Rows whose trailing-window mean exceeds ``threshold`` ("held for 5 minutes", WIN13)."""
    return rolling_stats(df, value_col, window_seconds, **kw).where(F.col("roll_mean") > threshold)


def bucket_spikes(rollup: DataFrame, value_col: str = "gpu_temp_avg", jump: float = 15.0,
                  key: str = "gpu_uuid") -> DataFrame:
    """Bucket-to-bucket change and spikes above ``jump`` (WIN6).

    Runs on rollup rows: one row per (device, bucket), so the per-device window
    is bounded by the time span, not by raw sample volume.
    """
    w = Window.partitionBy(key).orderBy("time")
    return (rollup.select(key, "time", value_col, F.lag(value_col).over(w).alias("prev"))
                  .withColumn("delta", F.col(value_col) - F.col("prev"))
                  .where(F.col("delta") > jump))


def largest_gaps(df: DataFrame, n: int = 10, key: str = "gpu_uuid", time_col: str = "time") -> DataFrame:
    """``lead(time) - time`` per device, largest first, top ``n`` (WIN7).

    The last sample of a device has a NULL gap, ordered last as in the SQL.
    """
    g = with_neighbours(df.select(key, time_col), [time_col], 0, 1, key, time_col)
    nxt = F.col(f"{time_col}_p1")
    gap = (F.unix_micros(nxt) - F.unix_micros(time_col)) / 1e6
    return (g.select(key, time_col, nxt.alias("next_time"), gap.alias("gap_seconds"))
             .orderBy(F.col("gap_seconds").desc_nulls_last(), key, time_col).limit(n))


def resample(df: DataFrame, value_col: str, every: str = "1 hour", key: str = "gpu_uuid") -> DataFrame:
    """Bucket means (WIN14)."""
    return (df.groupBy(key, F.window("time", every).alias("_w")).agg(F.avg(value_col).alias("value"))
              .select(key, F.col("_w.start").alias("time"), "value"))


def interpolate_grid(df: DataFrame, value_col: str, every_seconds: int = 3600, key: str = "gpu_uuid") -> DataFrame:
    """Regular grid between each device's first and last bucket, empty buckets
    filled linearly from the neighbouring non-empty buckets (WIN11).

    Every bucket with a value meets the next one in the ordered scan and unfolds the grid up
    to it, so no window runs over a device's grid. Buckets outside the first and the last
    value have nothing to interpolate from: they are NULL.
    """
    r = resample(df, value_col, f"{every_seconds} seconds", key)
    step = F.make_interval(secs=F.lit(every_seconds))
    met = with_neighbours(r.where(F.col("value").isNotNull()), ["time", "value"], ahead=1, key=key)
    at = F.explode(F.when(F.col("time_p1").isNull(), F.array("time")).otherwise(F.sequence(F.col("time"), F.col("time_p1") - step, step)))
    inner = met.select(key, F.col("time").alias("_t"), F.col("value").alias("_v"), "time_p1", "value_p1", at.alias("time"))
    seconds = lambda c: F.unix_seconds(c).cast("double")
    share = (seconds("time") - seconds("_t")) / (seconds("time_p1") - seconds("_t"))
    own = F.col("time") == F.col("_t")
    inner = inner.select(key, "time", F.when(own, F.col("_v")).otherwise(F.col("_v") + (F.col("value_p1") - F.col("_v")) * share).alias("value"),
                         (~own).alias("interpolated"))
    has = F.when(F.col("value").isNotNull(), F.col("time"))
    span = r.groupBy(key).agg(F.min("time").alias("lo"), F.max("time").alias("hi"), F.min(has).alias("from"), F.max(has).alias("to"))
    before = F.when(F.col("lo") < F.coalesce("from", F.col("hi") + step), F.sequence(F.col("lo"), F.coalesce(F.col("from") - step, F.col("hi")), step))
    after = F.when(F.col("to") < F.col("hi"), F.sequence(F.col("to") + step, F.col("hi"), step))
    none = F.array().cast("array<timestamp>")
    outer = span.select(key, F.explode(F.concat(F.coalesce(before, none), F.coalesce(after, none))).alias("time"))
    return inner.unionByName(outer.select(key, "time", F.lit(None).cast("double").alias("value"), F.lit(True).alias("interpolated")))


def risk_score(metrics: DataFrame, as_of: Column, window: str = "7 days") -> DataFrame:
    """0-100 failure-risk score with level bands (ANA10, design formula).

    ECC 40 % (50 correctable errors = full), +30 when any uncorrectable error,
    thermal 30 % (75-95 °C), throttling 20 % (10 events = full), power
    instability 10 % (std 50 W = full); levels (0,25] low ... (75,100] critical.
    """
    rows = window_rows(metrics, as_of, window)
    g = rows.groupBy("gpu_uuid").agg(
        (F.max("ecc_sbe_aggregate") - F.min("ecc_sbe_aggregate")).alias("ecc_correctable_7d"),
        (F.max("ecc_dbe_aggregate") - F.min("ecc_dbe_aggregate")).alias("ecc_uncorrectable_7d"),
        F.max("gpu_temp").alias("temp_max_7d"),
        F.count_if(F.col("throttle_reasons") > 0).alias("throttle_events_7d"),
        F.stddev_samp("power_usage").alias("power_std_7d"))

    def clip(c):
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    total = (clip(F.col("ecc_correctable_7d") / 50.0 * 100.0) * 0.4
             + F.when(F.col("ecc_uncorrectable_7d") > 0, 30.0).otherwise(0.0)
             + clip((F.col("temp_max_7d") - 75.0) / 20.0 * 100.0) * 0.3
             + clip(F.col("throttle_events_7d") / 10.0 * 100.0) * 0.2
             + clip(F.coalesce(F.col("power_std_7d"), F.lit(0.0)) / 50.0 * 100.0) * 0.1)
    score = F.round(clip(total).cast("decimal(38,12)"), 0).cast("int")
    level = None
    lo = 0
    for hi, name in RISK_LEVELS:
        cond = (F.col("risk_score") > lo) & (F.col("risk_score") <= hi)
        level = F.when(cond, name) if level is None else level.when(cond, name)
        lo = hi
    return g.withColumn("risk_score", score).withColumn("risk_level", level)


# Fixed values of the three-dimension score: weights of the parts.
PART_WEIGHTS = {"thermal": 0.35, "memory": 0.45, "power": 0.20}


def _percent(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def three_part_score(metrics: DataFrame, as_of: Column, window: str = "7 days") -> DataFrame:
    """Thermal, memory and power score per device and their rounded weighted mean (ANA10)."""
    g = window_rows(metrics, as_of, window).groupBy("gpu_uuid").agg(
        F.avg("gpu_temp").alias("t"), F.max("gpu_temp").alias("tx"), F.count_if(F.col("throttle_reasons") > 0).alias("thr"),
        F.sum("ecc_sbe_volatile").alias("sbe"), F.sum("ecc_dbe_volatile").alias("dbe"), F.stddev_samp("power_usage").alias("pv"))
    g = g.select("gpu_uuid", "thr", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("t", "tx", "sbe", "dbe", "pv")])
    over = lambda c, limit, factor: F.when(F.col(c) > limit, (F.col(c) - limit) * factor).otherwise(0.0)
    memory = F.lit(100.0) - F.least(F.lit(50.0), F.col("sbe") / 7.0)
    parts = {"thermal": _percent(100.0 - over("t", 75.0, 2.0) - over("tx", 85.0, 5.0) - F.col("thr") * 10.0),
             "memory": _percent(F.when(F.col("dbe") > 0, F.least(memory, F.lit(70.0))).otherwise(memory)),
             "power": _percent(100.0 - over("pv", 50.0, 0.5))}
    d = g.select("gpu_uuid", *[c.alias(f"{k}_score") for k, c in parts.items()])
    total = sum((F.col(f"{k}_score") * w for k, w in PART_WEIGHTS.items()), F.lit(0.0))
    return d.withColumn("overall", F.bround(total.cast("decimal(38,12)"), 0).cast("int"))


# Fixed values of the rule calculator: (price, hourly rate) per model, monthly cost,
# utilisation by health, shares of price.
RULE_PRICES = {"NVIDIA H100-SXM5-80GB": (40000.0, 3.50), "NVIDIA A100-SXM4-80GB": (15000.0, 1.50)}
RULE_MONTHLY_COST = 60.0 + 18.0 + 100.0 + 50.0
RULE_UTILISATION = ((85, 0.90), (70, 0.75), (50, 0.50))
RULE_LOWEST_UTILISATION = 0.25
RULE_HOURS = 730


def rule_valuation(scores: DataFrame, assets: DataFrame) -> DataFrame:
    """Value, monthly profit and recommendation per device of a priced model (ANA10)."""
    d = scores.select("gpu_uuid", F.col("overall_score").alias("h")).join(
        assets.select("gpu_uuid", "model").where(F.col("model").isin(list(RULE_PRICES))), "gpu_uuid")
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for m, v in RULE_PRICES.items() for x in (m, v[i])]), F.col("model"))
    use = F.lit(RULE_LOWEST_UTILISATION)
    for floor, u in reversed(RULE_UTILISATION):
        use = F.when(F.col("h") >= floor, u).otherwise(use)
    d = d.select("gpu_uuid", "model", "h", pick(0).alias("price"), (pick(1) * RULE_HOURS * use).alias("revenue"),
                 (RULE_MONTHLY_COST + (100 - F.col("h")) * 2).alias("cost"))
    d = d.withColumns({"residual": F.col("price") * (0.5 + F.col("h") / 100.0 * 0.7), "keep": (F.col("revenue") - F.col("cost")) * 12})
    what = F.when((F.col("h") >= 70) & (F.col("keep") > F.col("residual")), "KEEP").when(
        F.col("residual") > 0.5 * F.col("price"), "SELL").otherwise("DECOMMISSION")
    worth = F.when(F.col("what") == "KEEP", F.col("keep")).when(F.col("what") == "SELL", F.col("residual") * 0.95).otherwise(F.col("price") * 0.10)
    d = d.withColumn("what", what).withColumn("worth", worth)
    two = lambda c: F.round(c.cast("decimal(38,12)"), 2).cast("double")
    return d.select("gpu_uuid", "model", F.col("h").alias("health_score"), two(F.col("residual")).alias("residual_value"),
                    two(F.col("revenue")).alias("monthly_revenue"), two(F.col("cost")).alias("monthly_cost"),
                    two(F.col("revenue") - F.col("cost")).alias("monthly_profit"), two(F.col("keep")).alias("npv_keep_12m"),
                    F.col("what").alias("recommendation"), two(F.col("worth")).alias("expected_value"))


def grade_distribution(scores: DataFrame, col: str = "health_grade") -> DataFrame:
    """Count of devices per grade / level (AGG34)."""
    return scores.groupBy(col).agg(F.count(F.lit(1)).alias("devices"))


def hourly_fleet_kw(metrics: DataFrame, every: str = "1 hour") -> DataFrame:
    """Mean power per device and bucket, summed over the fleet, in kW (AGG33)."""
    per = metrics.groupBy(F.window("time", every).start.alias("time"), "gpu_uuid").agg(F.avg("power_usage").alias("_w"))
    return per.groupBy("time").agg((F.sum("_w") / 1000.0).alias("fleet_kw"), F.count(F.lit(1)).alias("gpus"))


def under_sampled(metrics: DataFrame, every: str = "1 minute", least: int = 5) -> DataFrame:
    """(device, bucket) pairs with fewer than ``least`` samples (AGG33)."""
    return (metrics.groupBy("gpu_uuid", F.window("time", every).start.alias("time")).agg(F.count(F.lit(1)).alias("samples"))
            .where(F.col("samples") < least))


def above_quantile(metrics: DataFrame, value_col: str = "gpu_temp", every: str = "1 day", p: float = 0.99) -> DataFrame:
    """Rows above the exact fleet quantile of their bucket (FLT11)."""
    q = bucket_percentile(metrics, every, value_col, p).select(F.col("time").alias("_t"), F.col("value").alias("limit"))
    d = metrics.withColumn("_t", F.window("time", every).start)
    return d.join(q, "_t").where(F.col(value_col) > F.col("limit")).select("time", "gpu_uuid", value_col, "limit")


def valuation_totals(decisions: DataFrame, as_of: Column, metrics: DataFrame, window: str = "24 hours") -> DataFrame:
    """Fleet valuation totals and the ECC errors of the window (AGG37)."""
    ecc = window_rows(metrics, as_of, window).agg(F.sum("ecc_sbe_volatile").alias("sbe"), F.sum("ecc_dbe_volatile").alias("dbe"))
    return decisions.agg(F.count(F.lit(1)).alias("gpus"), F.sum("npv_keep").alias("total_npv_keep"), F.sum("npv_sell").alias("total_npv_sell"),
                         F.sum("expected_value").alias("total_expected_value")).select(
        "*", ecc.select("sbe").scalar().alias("ecc_sbe_24h"), ecc.select("dbe").scalar().alias("ecc_dbe_24h"))


def throttle_leaderboard(metrics: DataFrame, as_of: Column, window: str = "24 hours") -> DataFrame:
    """Throttle events per device, most first (AGG33)."""
    return (window_rows(metrics, as_of, window, ahead=True).groupBy("gpu_uuid")
            .agg(F.count_if(F.col("throttle_reasons") > 0).alias("throttle_events"),
                 F.count(F.lit(1)).alias("samples"), F.min("time").alias("first_sample"),
                 F.max("time").alias("last_sample"))
            .orderBy(F.col("throttle_events").desc(), "gpu_uuid"))


def successive_change(metrics: DataFrame, value_col: str = "ecc_sbe_aggregate") -> DataFrame:
    """First-to-last rate per day and mean of successive differences (AGG35).

    The mean of successive differences telescopes to (last - first) / (n - 1),
    so both come from one algebraic aggregation (max_by / min_by on time).
    """
    g = metrics.groupBy("gpu_uuid").agg(
        F.count(value_col).alias("_n"),
        F.max_by(value_col, "time").alias("_last"), F.min_by(value_col, "time").alias("_first"),
        ((F.max(F.unix_micros("time")) - F.min(F.unix_micros("time"))) / 8.64e10).alias("_days"))
    delta = (F.col("_last") - F.col("_first")).cast("double")
    return g.select("gpu_uuid", F.try_divide(delta, F.col("_days")).alias("rate_per_day"),
                    F.try_divide(delta, (F.col("_n") - 1).cast("double")).alias("mean_successive_diff"))


def power_util_profile(metrics: DataFrame) -> DataFrame:
    """Correlation of power and utilisation plus percentiles of the temperature (AGG36).

    Percentiles use the mergeable sketch (bounded memory per device, rank error 1 / 10,000:
    exact up to 10,000 samples); the exact ``percentile`` would buffer a hot device's
    whole history in one task.
    """
    return metrics.groupBy("gpu_uuid").agg(
        F.corr("power_usage", "sm_active").alias("power_util_corr"),
        F.percentile_approx("gpu_temp", [0.5, 0.95, 0.99], 10000).alias("temp_p50_p95_p99"))


def fleet_recent(metrics: DataFrame, as_of: Column, window: str = "5 minutes") -> DataFrame:
    """Fleet aggregates over all rows of the last ``window`` (AGG37)."""
    return (window_rows(metrics, as_of, window, ahead=True)
            .agg(F.count_distinct("gpu_uuid").alias("gpus"), F.avg("gpu_temp").alias("avg_temp"),
                 F.max("gpu_temp").alias("max_temp"), (F.sum("power_usage") / 1000.0).alias("total_kw"),
                 F.count(F.lit(1)).alias("samples")))


def with_model_averages(latest: DataFrame, assets: DataFrame, value_col: str = "gpu_temp") -> DataFrame:
    """Each device's latest value next to its model's fleet average (JON15)."""
    j = latest.join(assets.select("gpu_uuid", "model"), "gpu_uuid", "left")
    avg = j.groupBy("model").agg(F.avg(value_col).alias("model_avg"), F.count(F.lit(1)).alias("model_devices"))
    return (j.join(avg, j["model"].eqNullSafe(avg["model"]), "left").drop(avg["model"])
             .withColumn("delta_vs_model", F.col(value_col) - F.col("model_avg")))


def merged_view(scores: DataFrame, risks: DataFrame, assets: DataFrame) -> DataFrame:
    """Health + risk + asset on the device id (JON13): two joins of one-row-per-device tables."""
    return scores.join(risks, "gpu_uuid", "inner").join(assets, "gpu_uuid", "inner")


def outcome_confusion(predictions: DataFrame, failures: DataFrame, horizon_days: int = 30,
                      threshold: float = 0.5) -> DataFrame:
    """Predictions against recorded failures within the horizon, by month (ANA11)."""
    f = failures.select("gpu_uuid", F.col("failure_date").cast("timestamp").alias("time"))
    met = asof_join(predictions.select("gpu_uuid", "time", "failure_prob_30d"), f)
    failed = F.coalesce(F.col("next_event.time") <= F.col("time") + F.make_dt_interval(days=F.lit(horizon_days)), F.lit(False))
    said = F.col("failure_prob_30d") >= threshold
    return met.groupBy(F.date_trunc("month", "time").alias("month")).agg(
        F.count_if(said & failed).alias("tp"), F.count_if(said & ~failed).alias("fp"), F.count_if(~said & failed).alias("fn"), F.count_if(~said & ~failed).alias("tn"))


def stream_static_inner(events: DataFrame, dim: DataFrame, key: str = "gpu_uuid") -> DataFrame:
    """Inner stream-static join to a global table (JON12)."""
    return events.join(dim, key, "inner")

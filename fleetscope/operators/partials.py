"""Per-(device, bucket) partials: one pass over raw rows, combined per device.

Raw rows are shuffled once by (device, bucket); the buckets count back from
``as_of``, so a window whose length is a whole number of buckets ends on a bucket
edge. A bucket's partial holds counts, sums and centred squares of the chosen
columns, its first and last sample time, the gaps inside it, the sums a trend over
the row index needs, and its first and last ``EDGE`` values of one column. Combining
them per device (a row per device and bucket) gives the exact statistics of the whole
window, and overlapping windows are combined from the same partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.timewin import interval_seconds

#: First and last values kept of a bucket (head and tail means use up to as many).
EDGE = 24


def moment_aggs(cols: dict[str, Column | str]) -> list[Column]:
    """Count, sum, centred squares, least and greatest of each named column."""
    out = []
    for name, c in cols.items():
        c = F.col(c) if isinstance(c, str) else c
        out += [F.count(c).alias(f"{name}__n"), F.sum(c.cast("double")).alias(f"{name}__s"),
                (F.var_pop(c) * F.count(c)).alias(f"{name}__q"), F.min(c).alias(f"{name}__lo"), F.max(c).alias(f"{name}__hi")]
    return out


def combined_moments(names) -> list[Column]:
    """Aggregates that add up the partials of ``moment_aggs``."""
    out = []
    for k in names:
        n, s = F.col(f"{k}__n"), F.col(f"{k}__s")
        out += [F.sum(n).alias(f"{k}__n"), F.sum(s).alias(f"{k}__s"),
                (F.sum(f"{k}__q") + F.sum(F.try_divide(s * s, n)) - F.try_divide(F.sum(s) * F.sum(s), F.sum(n))).alias(f"{k}__q"),
                F.min(f"{k}__lo").alias(f"{k}__lo"), F.max(f"{k}__hi").alias(f"{k}__hi")]
    return out


def mean(name: str) -> Column:
    return F.try_divide(F.col(f"{name}__s"), F.col(f"{name}__n").cast("double"))


def std(name: str, sample: bool = True) -> Column:
    """Sample (or population) deviation; exactly 0 where all values are equal."""
    n = F.col(f"{name}__n") - (1 if sample else 0)
    root = F.sqrt(F.greatest(F.col(f"{name}__q"), F.lit(0.0)) / n)
    return F.when(n > 0, F.when(F.col(f"{name}__lo") == F.col(f"{name}__hi"), F.lit(0.0)).otherwise(root))


def bucketed(rows: DataFrame, as_of: Column, bucket: str) -> DataFrame:
    """``rows`` with ``_b`` (0: the newest bucket, which ends at ``as_of``), ``_us`` and ``_rn`` within the bucket."""
    us = F.unix_micros(F.col("time").cast("timestamp"))
    width = int(interval_seconds(bucket) * 1_000_000)
    b = F.floor((F.unix_micros(as_of) - us) / F.lit(width)).cast("long")
    d = rows.withColumn("_us", us).withColumn("_b", b)
    w = Window.partitionBy("gpu_uuid", "_b").orderBy("_us")
    return d.withColumns({"_rn": F.row_number().over(w), "_prev": F.lag("_us").over(w),
                          "_n": F.count(F.lit(1)).over(Window.partitionBy("gpu_uuid", "_b"))})


def bucket_partials(rows: DataFrame, as_of: Column, bucket: str, aggs: list[Column], gap_seconds: float | None = None,
                    trend: str | None = None, edge: Column | None = None) -> DataFrame:
    """One row per (gpu_uuid, _b); ``aggs`` are further aggregates of the bucket's rows."""
    d = bucketed(rows, as_of, bucket)
    out = [F.count(F.lit(1)).alias("n"), F.min("_us").alias("first_us"), F.max("_us").alias("last_us"), *aggs]
    if gap_seconds is not None:
        out.append(F.count_if(F.col("_us") - F.col("_prev") > int(gap_seconds * 1_000_000)).alias("gaps"))
    if trend is not None:
        y = F.col(trend).cast("double")
        x = F.when(y.isNotNull(), F.col("_rn").cast("double"))
        out += [F.count(y).alias("t_n"), F.sum(x).alias("t_x"), F.sum(y).alias("t_y"), F.sum(x * y).alias("t_xy"), F.sum(x * x).alias("t_xx")]
    if edge is not None:
        item = lambda keep, rank: F.array_sort(F.collect_list(F.when(keep, F.struct(rank.alias("r"), edge.alias("v")))))
        back = F.col("_n") - F.col("_rn") + 1
        out += [item(F.col("_rn") <= EDGE, F.col("_rn")).alias("head"), item(back <= EDGE, back).alias("tail")]
    return d.groupBy("gpu_uuid", "_b").agg(*out)


def combine(partials: DataFrame, aggs: list[Column], keys=("gpu_uuid",), gap_seconds: float | None = None,
            trend: bool = False, edge: bool = False) -> DataFrame:
    """One row per key from its buckets: n, first_us, last_us, ``aggs``, and as asked
    gap_count, slope (least squares on the row index), head_sum and tail_sum."""
    old = Window.partitionBy(*keys).orderBy(F.col("_b").desc())
    before = F.coalesce(F.sum("n").over(old.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = partials.withColumn("_before", before)
    if gap_seconds is not None:
        d = d.withColumn("_prev_last", F.lag("last_us").over(old))
    if edge:
        new = Window.partitionBy(*keys).orderBy(F.col("_b").asc())
        d = d.withColumn("_after", F.coalesce(F.sum("n").over(new.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = [F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *aggs]
    if gap_seconds is not None:
        crossing = F.col("first_us") - F.col("_prev_last") > int(gap_seconds * 1_000_000)
        out.append((F.sum("gaps") + F.count_if(crossing)).alias("gap_count"))
    if edge:
        part = lambda c, used: F.aggregate(F.slice(c, 1, F.greatest(F.lit(EDGE) - used, F.lit(0)).cast("int")), F.lit(0.0),
                                           lambda acc, x: acc + x["v"])
        out += [F.sum(part("head", F.col("_before"))).alias("head_sum"), F.sum(part("tail", F.col("_after"))).alias("tail_sum")]
    if trend:
        off = (F.col("_before") - 1).cast("double")
        sx, sxy = F.sum(F.col("t_x") + off * F.col("t_n")), F.sum(F.col("t_xy") + off * F.col("t_y"))
        sxx = F.sum(F.col("t_xx") + 2 * off * F.col("t_x") + off * off * F.col("t_n"))
        tn, ty = F.sum("t_n").cast("double"), F.sum("t_y")
        out.append(F.try_divide(tn * sxy - sx * ty, F.nullif(tn * sxx - sx * sx, F.lit(0.0))).alias("slope"))
    return d.groupBy(*keys).agg(*out)

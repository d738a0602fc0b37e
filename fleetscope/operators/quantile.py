"""Exact quantiles of a whole fleet per time bucket, by histogram refinement (AGG30, FLT11).

A rank's value lies between the least and the greatest value of its bucket. That interval is
cut into equal bins, whose rows are counted before they are shuffled; the bin that holds the
rank, shrunk to the least and greatest value found in it, is the next interval. Ranks that
share a bin share the interval. Rows outside are not counted again; an interval of at most
``FEW`` values is sorted, one with a single value is done. The shuffles carry at most ``bins``
rows per interval and task, whatever the number of distinct values, and no task sees a
bucket's values.

Every round is a job over the two columns concerned; its state, a row per interval, is stored.
The number of rounds grows with the logarithm of the interval over the gap between
neighbouring values: one or two for a million evenly spread ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.session import store

INF = float("inf")
#: Most values of an interval that are sorted in one group.
FEW = 4096


def _first(values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(b, below, n, lo, hi, targets): the interval of each bucket and the ranks asked for.

    ``below`` values are smaller than ``lo``, ``n`` lie in the interval. Infinities and NaN
    (the greatest value of all) are no part of it: a rank among them is an interval of its own.
    """
    v = F.col("v")
    finite = (v > -INF) & (v < INF)
    s = values.groupBy("b").agg(F.count(F.lit(1)).alias("all"), F.count_if(v == -INF).alias("n_low"), F.count_if(finite).alias("n_fin"), F.count_if(v == INF).alias("n_high"),
                                F.min(F.when(finite, v)).alias("least"), F.max(F.when(finite, v)).alias("most"))
    rank = lambda p: (F.col("all") - 1) * F.lit(float(p))
    target = lambda name, p, side, f: F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), f(rank(p)).cast("long").alias("k"),
                                               (rank(p) - F.floor(rank(p))).alias("part"))
    targets = F.array(*[target(name, p, side, f) for name, p in shares.items() for side, f in (("lower", F.floor), ("upper", F.ceil))])
    kinds, below = [], F.lit(0).cast("long")
    for count, lo, hi in (("n_low", F.lit(-INF), F.lit(-INF)), ("n_fin", F.col("least"), F.col("most")), ("n_high", F.lit(INF), F.lit(INF)), (None, F.lit(float("nan")), F.lit(float("nan")))):
        n = F.col(count) if count else F.col("all") - below
        kinds.append(F.struct(below.alias("below"), n.alias("n"), lo.alias("lo"), hi.alias("hi")))
        below = below + n
    return _with_targets(s.withColumn("targets", targets).select("b", "targets", F.inline(F.array(*kinds))))


def _with_targets(intervals: DataFrame) -> DataFrame:
    """``intervals`` that hold a rank, with the ranks they hold."""
    here = F.filter("targets", lambda t: (t["k"] >= F.col("below")) & (t["k"] < F.col("below") + F.col("n")))
    return intervals.select("b", "below", "n", "lo", "hi", here.alias("targets")).where(F.size("targets") > 0)


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin 0 .. bins - 1 of a value; the ends of the interval are always in the first and the last one."""
    share = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)  # halves: the width of an interval may exceed a double
    inner = F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(0)), F.lit(bins - 1))
    return F.when(v >= hi, F.lit(bins - 1)).when(v <= lo, F.lit(0)).otherwise(inner).cast("int")


def _inside(values: DataFrame, state: DataFrame) -> DataFrame:
    return values.join(state.select("b", "below", "lo", "hi"), "b").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def _refined(values: DataFrame, state: DataFrame, bins: int) -> DataFrame:
    """One round: every interval becomes those of its bins that hold a rank."""
    counted = _inside(values, state).groupBy("b", F.col("below").alias("under"), _bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    before = F.sum("n").over(Window.partitionBy("b", "under").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))  # at most ``bins`` rows
    counted = counted.withColumn("below", F.col("under") + F.coalesce(before, F.lit(0)))
    return _with_targets(counted.join(state.select("b", F.col("below").alias("under"), "targets"), ["b", "under"]))


def exact_quantiles(rows: DataFrame, bucket: Column, value: Column, shares: dict[str, float], bins: int = 1024, few: int = FEW) -> DataFrame:
    """(b, one column per share): interpolated quantiles of ``value`` per ``bucket``, NULLs left out."""
    values = rows.select(bucket.alias("b"), value.cast("double").alias("v")).where(F.col("v").isNotNull())
    state, found = store(_first(values, shares), "quantile"), []
    one = ~(F.col("lo") < F.col("hi"))  # NaN is not below itself
    ranks = lambda d, v: d.select("b", "below", v, F.inline("targets"))
    while True:
        found.append(ranks(state.where(one), "lo").select("b", "q", "side", "part", F.col("lo").alias("v")))
        short = state.where(~one & (F.col("n") <= few))
        ordered = _inside(values, short).groupBy("b", "below").agg(F.sort_array(F.collect_list("v")).alias("sorted"))  # at most ``few`` values
        picked = ranks(ordered.join(short.select("b", "below", "targets"), ["b", "below"]), "sorted")
        found.append(picked.select("b", "q", "side", "part", F.get("sorted", (F.col("k") - F.col("below")).cast("int")).alias("v")))
        left = state.where(~one & (F.col("n") > few))
        if left.isEmpty():
            break
        state = store(_refined(values, left, bins), "quantile")
    low, high = (F.max(F.when(F.col("side") == side, F.col("v"))) for side in ("lower", "upper"))
    whole = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(F.col("a") + (F.col("z") - F.col("a")) * F.col("part"))
    per = reduce(DataFrame.unionByName, found).groupBy("b", "q").agg(low.alias("a"), high.alias("z"), F.max("part").alias("part")).select("b", "q", whole.alias("v"))
    return per.groupBy("b").agg(*[F.max(F.when(F.col("q") == name, F.col("v"))).alias(name) for name in shares])

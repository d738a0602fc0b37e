"""Time handling: explicit ``as_of`` instead of the wall clock, relative windows,
and partition predicates derived from time bounds."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of_col(df: DataFrame, as_of=None, time_col: str = "time", lazy: bool = True) -> Column:
    """``as_of`` as a Column.

    A given value becomes a literal. Otherwise it is ``max(time)`` of the input,
    by default as a lazy scalar subquery (reused across the plan). With
    ``lazy=False`` it is resolved once by a one-row aggregation (a scalar, not
    data, reaches the driver) and inlined as a literal, so the time filters are
    plain comparisons the parquet scan can push down — worth it on large
    date-partitioned tables, where callers usually pass ``as_of`` explicitly.
    """
    if as_of is None:
        agg = df.select(F.max(F.col(time_col)).cast("timestamp").alias("a"))
        if lazy:
            return agg.scalar()
        v = agg.first()[0]
        return F.lit(v).cast("timestamp") if v is not None else F.lit(None).cast("timestamp")
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        return F.lit(as_of).cast("timestamp")
    return F.lit(as_of)


def interval(spec: str) -> Column:
    """``'30 minutes'`` -> interval Column."""
    return F.expr(f"INTERVAL {spec}")


# Seconds of the units that window specifications use.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def interval_seconds(spec: str) -> float:
    """``'30 minutes'`` -> 1800.0."""
    n, unit = spec.split()
    return float(n) * UNIT_SECONDS[unit.rstrip("s").lower()]


def window_rows(df: DataFrame, as_of: Column, spec: str, strict: bool = True, time_col: str = "time",
                ahead: bool = False) -> DataFrame:
    """Rows of ``(as_of - spec, as_of]`` (``[`` unless ``strict``; no upper bound if
    ``ahead``): the reader that every operator with a time window uses.

    On a table partitioned by ``date`` the bounds are also given for that column, so only
    the days concerned are opened; ``as_of`` may be a literal or a scalar subquery.
    """
    t = F.col(time_col)
    out = df.where(since(t, as_of, spec, strict))
    if not ahead:
        out = out.where(t <= as_of)
    if "date" in df.columns:
        out = out.where(F.col("date") >= F.to_date(as_of - interval(spec)))
        if not ahead:
            out = out.where(F.col("date") <= F.to_date(as_of))
    return out


def since(time_col, as_of: Column, spec: str, strict: bool = True) -> Column:
    """``time > as_of - spec`` (strict, as most sites) or ``>=``."""
    t = F.col(time_col) if isinstance(time_col, str) else time_col
    lo = as_of - interval(spec)
    return (t > lo) if strict else (t >= lo)


def between_times(time_col, start, end) -> Column:
    """Absolute dashboard range, both ends inclusive (FLT2)."""
    t = F.col(time_col) if isinstance(time_col, str) else time_col
    return t.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def date_bounds(start: _dt.datetime | str | None, end: _dt.datetime | str | None,
                date_col: str = "date") -> Column | None:
    """Partition predicate on ``date`` derived from time bounds.

    Catalyst cannot infer ``date >= d`` from ``time >= t`` when ``date`` is a
    partition column, so time-range reads add it explicitly to prune directories.
    """
    conds = []
    if start is not None:
        conds.append(F.col(date_col) >= F.to_date(F.lit(str(start)).cast("timestamp")))
    if end is not None:
        conds.append(F.col(date_col) <= F.to_date(F.lit(str(end)).cast("timestamp")))
    if not conds:
        return None
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out

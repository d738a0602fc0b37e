"""Latest-row and top-N-per-key operators (WIN1, WIN4, TOP1, FLT7, JON9, JON11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys=("gpu_uuid",), time_col: str = "time",
                   cols=None) -> DataFrame:
    """``DISTINCT ON (keys) ... ORDER BY keys, time DESC`` as one aggregation.

    ``max_by(struct, time)`` is a declarative aggregate, so it runs partially on
    the map side: a device with a third of all rows still ships one row per map
    task to the shuffle, never its whole history.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in keys]
    if time_col not in cols:
        cols = [time_col] + cols
    packed = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*keys)
              .agg(F.max_by(packed, F.col(time_col)).alias("_latest"))
              .select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in cols]))


def latest_n_per_key(df: DataFrame, n: int, keys=("gpu_uuid",), time_col: str = "time", bucket: str = "1 day") -> DataFrame:
    """Latest ``n`` rows per key (TOP1 fleet-wide), with ``recency_rank`` from 1."""
    return _n_per_key(df, n, keys, time_col, bucket, True, "recency_rank")


def first_n_per_key(df: DataFrame, n: int, keys=("gpu_uuid",), time_col: str = "time", bucket: str = "1 day") -> DataFrame:
    """Earliest ``n`` rows per key, with ``age_rank`` from 1."""
    return _n_per_key(df, n, keys, time_col, bucket, False, "age_rank")


def _n_per_key(df: DataFrame, n: int, keys, time_col: str, bucket: str, newest: bool, out: str) -> DataFrame:
    """Up to the ``n`` that Spark plans as a partial limit, each map task forwards at most
    ``n`` rows per key. For a larger ``n`` rows are ranked within (key, time bucket); the
    rows of newer (older) buckets are counted on one row per key and bucket and added. So
    no key's history meets in one window, whatever ``n`` is."""
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n <= limit:
        of = [keys] if isinstance(keys, str) else list(keys)
        time = F.col(time_col).desc() if newest else F.col(time_col).asc()
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*of).orderBy(time))).where(F.col(out) <= n)
    keys = [keys] if isinstance(keys, str) else list(keys)
    d = df.withColumn("_b", F.window(F.col(time_col), bucket).start)
    order = F.col(time_col).desc() if newest else F.col(time_col).asc()
    sizes = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    past = Window.partitionBy(*keys).orderBy(F.col("_b").desc() if newest else F.col("_b").asc())
    ahead = F.coalesce(F.sum("_n").over(past.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # only buckets that can hold one of the n rows are joined back
    near = sizes.select(*keys, "_b", ahead.alias("_ahead")).where(F.col("_ahead") < n)
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order))
    return (d.join(near, [*keys, "_b"]).withColumn(out, (F.col("_ahead") + rank).cast("int"))
             .where(F.col(out) <= n).drop("_b", "_ahead"))


def rows_at_group_max(df: DataFrame, keys, value_col: str) -> DataFrame:
    """Rows whose ``value_col`` equals its group maximum (correlated ``MAX`` subquery, FLT7/JON9).

    Ties are all kept, as the SQL form keeps them. The group maxima are one row
    per key and are joined back on the key (AQE broadcasts them when small).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    mx = df.groupBy(*keys).agg(F.max(value_col).alias("_gmax"))
    return (df.join(mx, keys, "inner").where(F.col(value_col) == F.col("_gmax")).drop("_gmax"))


def global_latest_snapshot(df: DataFrame, time_col: str = "time") -> DataFrame:
    """Rows at ``time = (SELECT max(time))`` (FLT8), an uncorrelated scalar subquery."""
    return df.where(F.col(time_col) == df.select(F.max(time_col)).scalar())

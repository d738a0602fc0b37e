"""Order-dependent per-device statistics that stay skew-safe (WIN2, WIN5, AGG19).

A window partitioned by device alone sends a hot device's whole history to one task. These
statistics come from the ordered scan (``operators/scan.py``), which range-partitions by
(device, time) and stitches the partitions from their boundary rows. Results are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.scan import with_neighbours


def gap_counts(df: DataFrame, key: str = "gpu_uuid", time_col: str = "time", threshold_seconds: float = 300) -> DataFrame:
    """Per key: number of consecutive samples more than ``threshold_seconds`` apart."""
    t = df.select(key, F.unix_micros(F.col(time_col).cast("timestamp")).alias("_us"))
    gap = F.col("_us") - F.col("_us_m1")
    return (with_neighbours(t, ["_us"], back=1, key=key, time_col="_us").groupBy(key)
            .agg(F.count_if(gap > F.lit(int(threshold_seconds * 1_000_000))).alias("gap_count")))


def with_row_index(df: DataFrame, key: str = "gpu_uuid", time_col: str = "time") -> DataFrame:
    """0-based position of each row in its key's time order, as ``row_index`` (WIN5)."""
    return with_neighbours(df, [], key=key, time_col=time_col)


def index_slope(df: DataFrame, value_col: str, key: str = "gpu_uuid", time_col: str = "time", min_rows: int = 3) -> DataFrame:
    """Least-squares slope of ``value_col`` on the row index (AGG19).

    Rows with a NULL value keep their index but do not enter the fit; keys with
    fewer than ``min_rows`` rows get 0, as the reference does for n <= 2.
    """
    idx = with_row_index(df.select(key, time_col, value_col), key, time_col)
    return (idx.groupBy(key)
               .agg(F.count(F.lit(1)).alias("_n"),
                    F.regr_slope(F.col(value_col), F.col("row_index").cast("double")).alias("_s"))
               .select(key, F.when(F.col("_n") >= min_rows, F.col("_s")).otherwise(F.lit(0.0)).alias("slope")))

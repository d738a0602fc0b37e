"""Per-device running statistics from bucket totals (STR8).

A device's samples are first added up per time bucket by a streaming aggregation, which combines
in every task before the shuffle: however many samples a device sends in a micro-batch, the
stateful step sees one row per device and closed bucket. It compares a bucket's extremes with
the device's mean and deviation over all buckets before, flags those beyond ``z``, and then
absorbs the bucket's totals (count, mean, squares about the mean). State is these totals alone and
goes by an event-time timer when a device has sent nothing for ``ttl``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "gpu_uuid string, time timestamp, anomaly_type string, value double, z_score double, baseline_mean double, severity string"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def absorb(state: tuple[int, float, float], n: int, mean: float, m2: float) -> tuple[int, float, float]:
    """Totals of two sets of values from those of each."""
    n0, mean0, m20 = state
    total = n0 + n
    if not total:
        return state
    away = mean - mean0
    return total, mean0 + away * n / total, m20 + m2 + away * away * n0 * n / total


def judge(state: tuple[int, float, float], low: float, high: float, z: float, min_samples: int) -> list[tuple[float, float]]:
    """(value, score) of the bucket's extremes that lie beyond ``z`` deviations of the totals before it."""
    n, mean, m2 = state
    if n < max(2, min_samples) or m2 <= 0:
        return []
    std = (m2 / (n - 1)) ** 0.5
    return [(v, abs(v - mean) / std) for v in dict.fromkeys((low, high)) if abs(v - mean) / std > z]


class RunningMoments(StatefulProcessor):
    def __init__(self, z: float, min_samples: int, ttl_ms: int):
        self.z, self.min_samples, self.ttl_ms = z, min_samples, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, mean double, m2 double, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2, last = self.totals.get() if self.totals.exists() else (0, 0.0, 0.0, 0)
        state, found = (n, mean, m2), []
        buckets = pd.concat(list(rows)).sort_values("time")  # one row per closed bucket
        for b in buckets.itertuples():
            at = int(pd.Timestamp(b.time).timestamp() * 1000)
            if state[0] and at - last > self.ttl_ms:  # the timer may come with the same batch, after its rows
                state = (0, 0.0, 0.0)
            for value, score in judge(state, b.low, b.high, self.z, self.min_samples):
                found.append((key[0], b.time, "temperature", value, round(score, 2), round(state[1], 2), "high" if score > 4 else "medium"))
            state = absorb(state, int(b.n), float(b.mean), float(b.m2))
            last = max(last, at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.totals.update((*state, last))
        self.handle.registerTimer(last + self.ttl_ms)
        yield pd.DataFrame(found, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.totals.clear()
        yield pd.DataFrame([], columns=COLUMNS)

    def close(self) -> None:
        pass


def bucket_totals(metrics: DataFrame, bucket: str = "5 minutes") -> DataFrame:
    """(gpu_uuid, time, n, mean, m2, low, high) per device and bucket; ``time`` is the bucket's end."""
    x = F.col("gpu_temp")
    w = metrics.where(x.isNotNull()).groupBy("gpu_uuid", F.window("time", bucket).alias("w")).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high"))
    return w.select("gpu_uuid", F.window_time("w").alias("time"), "n", "mean", "m2", "low", "high")


def bucket_anomalies(metrics_stream: DataFrame, z: float = 3.0, min_samples: int = 2, bucket: str = "5 minutes", ttl: str = "7 days", lateness: str = "1 hour") -> DataFrame:
    """Anomalous bucket extremes of a metrics stream; ``time`` is the end of the bucket."""
    totals = bucket_totals(metrics_stream.withWatermark("time", lateness), bucket)
    processor = RunningMoments(z, min_samples, int(pd.Timedelta(ttl).total_seconds() * 1000))
    return totals.groupBy("gpu_uuid").transformWithStateInPandas(processor, OUTPUT, "append", "eventTime")

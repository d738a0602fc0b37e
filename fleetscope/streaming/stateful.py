"""Per-device streaming anomaly detector with running statistics (STR8).

State per device is (n, mean, M2, last_seen). A sample is flagged when
|x - mean| / std > z against the statistics *before* it is absorbed. The samples of a
micro-batch are put in time order once and folded with prefix sums: no loop over rows.
Devices idle longer than the TTL are evicted by an event-time timeout, so state stays
bounded by the active fleet. Batches arrive as pandas frames over Arrow
(``applyInPandasWithState``); one device's samples of one micro-batch meet in one task.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

OUTPUT_SCHEMA = ("gpu_uuid string, time timestamp, anomaly_type string, value double, "
                 "z_score double, baseline_mean double, severity string")
STATE_SCHEMA = "n long, mean double, m2 double, last_seen timestamp"
OUTPUT_COLUMNS = [c.split()[0] for c in OUTPUT_SCHEMA.split(", ")]


def fold(x: np.ndarray, n: int, mean: float, m2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(n, mean, M2 before each value, state after all of them) of values in order."""
    centre = mean if n else (float(x[0]) if len(x) else 0.0)
    c = x - centre
    s, q = np.concatenate([[0.0], np.cumsum(c)]), np.concatenate([[0.0], np.cumsum(c * c)])
    count = n + np.arange(len(x) + 1)
    shift = s / np.maximum(count, 1)
    means = centre + shift
    squares = np.maximum(m2 + q - count * shift * shift, 0.0)
    return count[:-1], means[:-1], squares[:-1], (int(count[-1]), float(means[-1]), float(squares[-1]))


def _detector(z_threshold: float, min_samples: int, ttl_ms: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, mean, m2, last = (state.get if state.exists else (0, 0.0, 0.0, None))
        d = pd.concat([f[["time", "gpu_temp"]] for f in pdfs])
        d = d[d["gpu_temp"].notna() & d["time"].notna()].sort_values("time", kind="stable")
        found = pd.DataFrame()
        if len(d):
            x = d["gpu_temp"].to_numpy(float)
            count, means, squares, (n, mean, m2) = fold(x, n, mean, m2)
            known = (count >= max(2, min_samples)) & (squares > 0)
            std = np.sqrt(np.where(known, squares, 1.0) / np.maximum(count - 1, 1))
            score = np.where(known, np.abs(x - means) / std, 0.0)
            hit = score > z_threshold
            found = pd.DataFrame({"gpu_uuid": key[0], "time": d["time"].to_numpy()[hit], "anomaly_type": "temperature", "value": x[hit],
                                  "z_score": score[hit].round(2), "baseline_mean": means[hit].round(2),
                                  "severity": np.where(score[hit] > 4, "high", "medium")}, columns=OUTPUT_COLUMNS)
            newest = d["time"].iloc[-1]
            last = newest if last is None or newest > last else last
        if n:  # a device without a single reading so far needs no state
            state.update((n, mean, m2, last))
            seen = int(pd.Timestamp(last).timestamp() * 1000)
            state.setTimeoutTimestamp(max(seen + ttl_ms, state.getCurrentWatermarkMs() + 1))
        if len(found):
            yield found
    return fn


def running_zscore_anomalies(metrics_stream: DataFrame, z: float = 3.0, min_samples: int = 2,
                             ttl: str = "7 days", lateness: str = "1 hour") -> DataFrame:
    """Stateful temperature anomaly stream, keyed by device."""
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    return (metrics_stream.withWatermark("time", lateness)
            .groupBy("gpu_uuid")
            .applyInPandasWithState(_detector(z, min_samples, ttl_ms), OUTPUT_SCHEMA, STATE_SCHEMA,
                                    "append", GroupStateTimeout.EventTimeTimeout))

"""Alert lifecycle on a prediction stream (STR10, ANA6): open, escalate, renew, close.

Each device has at most one open alert. A prediction that reaches a tier opens it, or, if the
alert is open, escalates it when the tier is higher than any before; repeats are suppressed until
``renew_after`` has passed since the last notice. An alert closes when a prediction falls below
every tier, or, by an event-time timer, when none has confirmed it for ``quiet``. State is
one small row per device with an open alert and goes with the alert.

``step`` is the whole rule, for one device's predictions in time order; the stream keeps its
state with ``transformWithStateInPandas``. ``write_events`` replaces the folder of a batch id,
so a batch that is run again after a failure leaves the same rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetscope.operators.alerts import ALERT_TIERS, alert_level

#: Lowest first; a higher rank is more urgent.
LEVELS = [t[0] for t in reversed(ALERT_TIERS)]
ACTIONS = {t[0]: t[4] for t in ALERT_TIERS}
EVENTS = "alert_id string, gpu_uuid string, event string, level string, time timestamp, opened_at timestamp, action string"
COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]
STATE = "level string, opened_at timestamp, noticed_at timestamp, seen_at timestamp"


def _event(gpu: str, event: str, level: str, time: dt.datetime, opened: dt.datetime) -> dict:
    return dict(zip(COLUMNS, (f"{gpu}@{opened:%Y%m%dT%H%M%S%f}", gpu, event, level, time, opened, ACTIONS[level] if event != "closed" else None)))


def step(gpu: str, state: tuple | None, predictions: Iterable[tuple], renew_after: dt.timedelta, quiet: dt.timedelta) -> tuple[tuple | None, list[dict]]:
    """(state, events) after ``predictions`` (time, level or None) in time order; state is (level, opened_at, noticed_at, seen_at)."""
    out = []
    for time, level in predictions:
        if state is not None and time - state[3] > quiet:  # nothing confirmed it in time
            out.append(_event(gpu, "closed", state[0], state[3] + quiet, state[1]))
            state = None
        if state is not None and time < state[3]:
            continue  # a late prediction changes nothing
        if level is None:
            if state is not None:
                out.append(_event(gpu, "closed", state[0], time, state[1]))
            state = None
        elif state is None:
            state = (level, time, time, time)
            out.append(_event(gpu, "opened", level, time, time))
        elif LEVELS.index(level) > LEVELS.index(state[0]):
            state = (level, state[1], time, time)
            out.append(_event(gpu, "escalated", level, time, state[1]))
        elif time - state[2] >= renew_after:
            state = (state[0], state[1], time, time)
            out.append(_event(gpu, "renewed", state[0], time, state[1]))
        else:
            state = (*state[:3], time)
    return state, out


class AlertLifecycle(StatefulProcessor):
    """``step`` per device, with a timer that closes an alert nothing confirms."""

    def __init__(self, renew_after: dt.timedelta, quiet: dt.timedelta):
        self.renew_after, self.quiet = renew_after, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", STATE)

    def _keep(self, state: tuple | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.state.clear()
            return
        self.state.update(state)
        self.handle.registerTimer(int((state[3] + self.quiet).timestamp() * 1000) + 1)

    def _held(self) -> tuple | None:
        if not self.state.exists():
            return None
        level, *times = self.state.get()
        return (level, *(pd.Timestamp(t).to_pydatetime() for t in times))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one row per device and prediction run: a micro-batch holds few of a device
        found = sorted(((pd.Timestamp(t).to_pydatetime(), level if isinstance(level, str) else None) for f in rows for t, level in zip(f["time"], f["level"])),
                       key=lambda r: (r[0], r[1] is not None, LEVELS.index(r[1]) if r[1] else 0))
        state, events = step(key[0], self._held(), found, self.renew_after, self.quiet)
        self._keep(state)
        yield pd.DataFrame(events, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._held()
        events = [] if state is None else [_event(key[0], "closed", state[0], state[3] + self.quiet, state[1])]
        self.state.clear()
        yield pd.DataFrame(events, columns=COLUMNS)

    def close(self) -> None:
        pass


def alert_stream(predictions: DataFrame, renew_after: str = "4 hours", quiet: str = "24 hours", lateness: str = "1 hour") -> DataFrame:
    """Alert events of a prediction stream (time, gpu_uuid, failure_prob_*, confidence)."""
    processor = AlertLifecycle(pd.Timedelta(renew_after).to_pytimedelta(), pd.Timedelta(quiet).to_pytimedelta())
    levels = predictions.withWatermark("time", lateness).select("gpu_uuid", "time", alert_level()["level"].alias("level"))
    return levels.groupBy("gpu_uuid").transformWithStateInPandas(processor, EVENTS, "append", "eventTime")


def write_events(events: DataFrame, path: str, batch_id: int) -> None:
    """The events of one micro-batch, in a folder of its own that a repeat replaces."""
    events.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def start_alerts(predictions: DataFrame, path: str, checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """Run ``alert_stream`` into the table at ``path``, each batch exactly once."""
    predictions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    w = alert_stream(predictions, **options).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    w = w.foreachBatch(lambda df, i: write_events(df, path, i))
    return (w.trigger(availableNow=True) if available_now else w).start()

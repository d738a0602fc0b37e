"""Structured Streaming ingest: raw -> validated / dead-letter -> enriched -> stored
(STR1-STR6, STR9, SNK1, SRC2, SRC4).

The reference's three services joined by topics become one streaming query:
each micro-batch is validated once (persisted), split into the dead-letter
and valid outputs, enriched against the asset dimension re-read per batch,
flattened, and appended with key-level dedup. Dead letters are kept per batch id, so
a replayed batch after a failure writes nothing twice to either output.
"""

from __future__ import annotations

import time
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.operators import enrich as enrich_op
from fleetscope.operators import tables, validate
from fleetscope.operators.asof import version_at
from fleetscope.operators.rollups import rollup


def read_raw(spark: SparkSession, source: str, fmt: str = "text", max_files_per_trigger: int | None = None,
             kafka_options: dict | None = None) -> DataFrame:
    """Raw event stream with a string ``value`` column (SRC2).

    ``fmt='kafka'`` reads a topic from the earliest offset (needs the Kafka
    connector on the classpath); ``'text'`` reads JSON lines from files behind
    the same ``value`` column.
    """
    if fmt == "kafka":
        opts = {"subscribe": source, "startingOffsets": "earliest", **(kafka_options or {})}
        r = spark.readStream.format("kafka").options(**opts).load()
        return r.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source).select(F.lit(None).cast("string").alias("key"), F.col("value"))


def process_batch(batch: DataFrame, assets: DataFrame, metrics_path: str, dead_letter_path: str,
                  now=None, epoch_id: int = 0) -> None:
    """One micro-batch of the pipeline (validate -> split -> enrich -> flatten -> sink).

    Dead letters go to a folder of the batch's own, overwritten when the batch is replayed;
    stored rows are skipped by key. So a replay changes neither output.
    """
    now = now if now is not None else F.current_timestamp()
    checked = validate.validate(batch, now=now).persist()
    try:
        validate.dead_letters(checked, now=now).select("dead_letter.*") \
                .write.mode("overwrite").json(f"{dead_letter_path.rstrip('/')}/batch_id={epoch_id}")
        ok = validate.valid_events(checked, now=now)
        flat = enrich_op.flatten(enrich_op.enrich(ok, assets, now=now))
        tables.append_ignore(flat, metrics_path, ["time", "gpu_uuid"])
    finally:
        checked.unpersist()


class RefreshingDimension:
    """A dimension re-read at most every ``ttl_seconds`` (SRC4: the asset cache).

    Between refreshes micro-batches join against the persisted copy; on refresh
    the old copy is unpersisted. The clock is the driver's wall clock, as for
    the reference's cache TTL.
    """

    def __init__(self, load: Callable[[], DataFrame], ttl_seconds: float = 300.0, clock=time.monotonic):
        self._load, self._ttl, self._clock = load, ttl_seconds, clock
        self._df: DataFrame | None = None
        self._at = float("-inf")
        self.refreshes = 0

    def __call__(self) -> DataFrame:
        now = self._clock()
        if self._df is None or now - self._at >= self._ttl:
            old = self._df
            self._df = self._load().persist()
            self._at = now
            self.refreshes += 1
            if old is not None:
                old.unpersist()
        return self._df


def start_ingest(spark: SparkSession, source: str, metrics_path: str, dead_letter_path: str,
                 checkpoint: str, load_assets: Callable[[], DataFrame], fmt: str = "text",
                 trigger_seconds: int = 5, available_now: bool = False, max_files_per_trigger: int | None = None, now=None):
    """Start the ingest query (STR1, STR3). ``load_assets`` is called per batch; wrap
    it in ``RefreshingDimension`` to re-read the assets at most every 300 s."""
    raw = read_raw(spark, source, fmt, max_files_per_trigger)

    def run(batch: DataFrame, epoch_id: int) -> None:
        process_batch(batch, load_assets(), metrics_path, dead_letter_path, now, epoch_id)

    w = raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


def streaming_rollup(metrics_stream: DataFrame, every: str = "5 minutes", lateness: str = "1 hour",
                     power_min: bool = True) -> DataFrame:
    """Tumbling-window rollup of a telemetry stream (STR6, STR7 with ``lateness='0 seconds'``).

    The watermark bounds state and lateness (events older than 1 h are rejected
    upstream anyway); duplicates of (device, time) are dropped within it (STR4).
    Append mode emits each bucket once it closes.
    """
    d = (metrics_stream.withWatermark("time", lateness)
                       .dropDuplicatesWithinWatermark(["gpu_uuid", "time"]))
    return rollup(d, every, power_min)


def start_rollup(metrics_stream: DataFrame, path: str, checkpoint: str, every: str = "5 minutes",
                 lateness: str = "1 hour", available_now: bool = False):
    """Write closed rollup buckets to a date-partitioned table."""
    out = tables.with_date(streaming_rollup(metrics_stream, every, lateness))
    w = out.writeStream.outputMode("append").format("parquet").partitionBy(tables.PART_COL) \
           .option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_versioned_enrichment(stream: DataFrame, versions: Callable[[], DataFrame], columns: list[str], path: str, checkpoint: str,
                               available_now: bool = False):
    """Write a stream with the dimension version valid at each event's own time (JON12, SRC4).

    ``versions`` is called per batch and may be a ``RefreshingDimension``. Events that arrive after an asset
    moved still get the place they were measured at. Each batch id has a folder that a repeat replaces.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        found = version_at(batch, versions(), columns).withColumn("batch_id", F.lit(batch_id))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()

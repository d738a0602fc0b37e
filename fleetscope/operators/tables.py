"""Table maintenance on date-partitioned parquet tables (SRC3, SRC7, SNK2-SNK11).

Every operation evaluates its input once and rewrites only the partitions its rows concern. The
new content is first written whole into a pending folder beside the table; Spark's dynamic
partition overwrite then puts it in place. An operation that ends in between is finished by
the next one, or by ``replay``: overwriting from a complete pending folder again gives the same
table, an incomplete one is dropped and the operation never took place. ``MERGE INTO`` needs a
v2 table format that this install lacks; these are its plain-parquet equivalents. One writer per
table at a time; a reader beside it may see a partition before its replacement.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.functions.timewin import date_bounds
from fleetscope.session import checkpoint_dir

PART_COL = "date"

# Retention per table in days.
RETENTION_DAYS = {"gpu_metrics": 7, "anomalies": 90, "gpu_features": 365, "gpu_economic_decisions": 730,
                  "gpu_market_commentary": 30}


def with_date(df: DataFrame, time_col: str = "time") -> DataFrame:
    return df if PART_COL in df.columns else df.withColumn(PART_COL, F.to_date(F.col(time_col)))


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) for any Hadoop path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when it does not exist or holds no data files
    yet (an empty first write leaves only a success marker)."""
    if not _exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def read_range(spark: SparkSession, path: str, start=None, end=None, time_col: str = "time",
               cols=None) -> DataFrame:
    """Time-bounded scan (SRC3): a ``date`` predicate derived from the time bounds
    prunes partitions; the ``time`` predicate is pushed to the parquet reader."""
    df = spark.read.parquet(path)
    d = date_bounds(start, end, PART_COL)
    if d is not None:
        df = df.where(d)
    if start is not None:
        df = df.where(F.col(time_col) >= F.lit(str(start)).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(time_col) <= F.lit(str(end)).cast("timestamp"))
    return df.select(*cols) if cols else df


@contextmanager
def staged(df: DataFrame):
    """``df`` evaluated once into a folder of the shared checkpoint directory, which goes at the end."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/staging-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _delete(spark, path)


def _pending(path: str) -> str:
    return f"{path.rstrip('/')}-pending"


def replay(spark: SparkSession, path: str) -> None:
    """Put a complete pending folder of ``path`` in place (again), drop an incomplete one.

    ``rows`` holds the new content of whole partitions, ``touched`` the values of all partitions
    concerned (none for a table without partitions); those without rows are removed.
    """
    pending = _pending(path)
    if not _exists(spark, pending):
        return
    if _exists(spark, f"{pending}/rows/_SUCCESS"):
        touched = spark.read.parquet(f"{pending}/touched")
        rows = read_or_none(spark, f"{pending}/rows")
        part_col = touched.columns[0] if touched.columns[0] != "_whole" else None
        if part_col is None:
            if rows is not None:
                rows.write.mode("overwrite").parquet(path)
        else:
            if rows is not None:
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part_col).parquet(path)
                touched = touched.join(rows.select(F.col(part_col).cast("string").alias("_has")).distinct(), F.col(part_col).eqNullSafe(F.col("_has")), "left_anti")
            _drop_partitions(spark, path, part_col, [r[0] for r in touched.collect()])
    _delete(spark, pending)


def _replace(rows: DataFrame, path: str, part_col: str | None, touched=()) -> None:
    """Give the partitions of ``rows`` and of ``touched`` the content of ``rows``; all of the table without ``part_col``."""
    spark, pending = rows.sparkSession, _pending(path)
    values = [(None if v is None else str(v),) for v in touched] if part_col else [("",)]
    spark.createDataFrame(values, f"`{part_col or '_whole'}` string").write.parquet(f"{pending}/touched")
    (rows.write.partitionBy(part_col) if part_col else rows.write).parquet(f"{pending}/rows")
    replay(spark, path)


def _in(c: str, values) -> Column:
    """Whether a column has one of the values, NULL among them if it is one."""
    known = [v for v in values if v is not None]
    found = F.col(c).isin(known) if known else F.lit(False)
    return found | F.col(c).isNull() if len(known) < len(list(values)) else found


def first_per_key(df: DataFrame, keys, order_col: str, newest: bool = False) -> DataFrame:
    """One row per key: the first (or newest) by ``order_col``."""
    o = F.col(order_col).desc() if newest else F.col(order_col).asc()
    w = Window.partitionBy(*keys).orderBy(o)
    return df.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def ignore_frame(new: DataFrame, old: DataFrame | None, keys, order_col: str) -> DataFrame:
    """Rows that INSERT ... ON CONFLICT DO NOTHING inserts (SNK2), without writing."""
    d = first_per_key(new, keys, order_col)
    return d if old is None else d.join(old.select(*keys).distinct(), list(keys), "left_anti")


def upsert_frame(new: DataFrame, old: DataFrame | None, keys, update_cols=None, updated_at: Column | None = None) -> DataFrame:
    """Old rows with the new ones merged in (SNK3, SNK4, SNK7), without writing.

    ``new`` has one row per key. New keys insert whole rows; known keys take the new values
    of ``update_cols`` (all non-key columns when None) and keep the rest.
    """
    if old is None:
        return new if updated_at is None else new.withColumn("updated_at", updated_at)
    keys = list(keys)
    update = set(update_cols) if update_cols is not None else {c for c in new.columns if c not in keys}
    j = old.alias("o").join(new.withColumn("_is_new", F.lit(True)).alias("n"), keys, "full_outer")
    fresh = F.coalesce(F.col("n._is_new"), F.lit(False))
    out = [F.col(k) for k in keys]
    for c in [c for c in old.columns if c not in keys]:
        if c == "updated_at" and updated_at is not None:
            out.append(F.when(fresh, updated_at).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in update and c in new.columns:
            out.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in new.columns:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return j.select(*out)


def append(df: DataFrame, path: str, time_col: str = "time") -> None:
    """Plain append (SNK5)."""
    with_date(df, time_col).write.mode("append").partitionBy(PART_COL).parquet(path)


def append_ignore(df: DataFrame, path: str, keys, time_col: str = "time", order_col: str | None = None) -> None:
    """INSERT ... ON CONFLICT DO NOTHING (SNK2, STR4): the first row per key wins inside
    the batch, keys already stored are skipped, so a replayed batch is a no-op.

    First is the smallest ``order_col``, else the arrival order of the batch, which the
    staging folder fixes. Stored keys are read from the batch's own dates and, with
    ``time_col`` among the keys, its own time range, both literals that prune the scan.
    """
    spark = df.sparkSession
    replay(spark, path)
    with staged(with_date(df, time_col).withColumn("_arrival", F.monotonically_increasing_id())) as batch:
        old = read_or_none(spark, path)
        if old is not None:
            dates = [r[0] for r in batch.select(PART_COL).distinct().collect()]  # a batch's days
            old = old.where(F.col(PART_COL).isin(dates))
            if time_col in keys:
                lo, hi = batch.agg(F.min(time_col), F.max(time_col)).first()
                old = old.where(F.col(time_col).between(F.lit(lo), F.lit(hi))) if lo is not None else old.limit(0)
        fresh = ignore_frame(batch, old, keys, order_col or "_arrival").drop("_arrival")
        fresh.write.mode("append").partitionBy(PART_COL).parquet(path)


def upsert(df: DataFrame, path: str, keys, time_col: str = "time", update_cols=None, updated_at: Column | None = None,
           order_col: str | None = None, part_col: str | None = PART_COL) -> None:
    """INSERT ... ON CONFLICT DO UPDATE (SNK3 full, SNK4 partial, SNK7 ``updated_at``).

    ``part_col`` is the table's partition column, None for a plain table such as a
    dimension. If the keys hold ``time_col``, from which the date derives, a key can only
    be stored under its own date; otherwise keys are matched over the whole table, and a
    row whose partition changes leaves the old one. Of several new rows per key the
    newest by ``order_col`` (else the last to arrive) counts.
    """
    spark = df.sparkSession
    replay(spark, path)
    new = with_date(df, time_col) if part_col == PART_COL else df
    with staged(new.withColumn("_arrival", F.monotonically_increasing_id())) as batch:
        rows = first_per_key(batch, keys, order_col or "_arrival", newest=True).drop("_arrival")
        stored = read_or_none(spark, path)
        if stored is None:
            _replace(upsert_frame(rows, None, keys, update_cols, updated_at), path, part_col)
            return
        if part_col is None:
            _replace(upsert_frame(rows, stored, keys, update_cols, updated_at), path, None)
            return
        parts = {r[0] for r in rows.select(part_col).distinct().collect()}
        if time_col not in keys or part_col != PART_COL:
            where = stored.join(rows.select(*keys), list(keys), "left_semi").select(part_col).distinct()
            parts |= {r[0] for r in where.collect()}
        old = stored.where(_in(part_col, parts))
        _replace(upsert_frame(rows, old, keys, update_cols, updated_at), path, part_col, parts)


def delete_where(spark: SparkSession, path: str, predicate: Column) -> None:
    """DELETE ... WHERE (SNK6): partitions holding matches are rewritten without
    them; partitions left empty are removed."""
    replay(spark, path)
    df = spark.read.parquet(path)
    hit = [r[0] for r in df.where(predicate).select(PART_COL).distinct().collect()]
    if hit:
        keep = df.where(_in(PART_COL, hit) & ~F.coalesce(predicate, F.lit(False)))
        _replace(keep, path, PART_COL, hit)


def _drop_partitions(spark: SparkSession, path: str, part_col: str, values) -> None:
    name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for v in values:
        _delete(spark, f"{path.rstrip('/')}/{name(part_col, None if v is None else str(v))}")


def apply_retention(spark: SparkSession, path: str, days: int, as_of) -> list:
    """Drop ``date`` partitions older than ``as_of - days`` (SNK8), chunk-granular.

    Only the list of partition values is read (a distinct over the partition
    column, answered from the directory listing), never the rows.
    """
    replay(spark, path)
    df = spark.read.parquet(path)
    cutoff = F.date_sub(F.to_date(F.lit(str(as_of)).cast("timestamp")), days)
    old = [r[0] for r in df.select(PART_COL).distinct().where(F.col(PART_COL) < cutoff).collect()]
    _drop_partitions(spark, path, PART_COL, old)
    return old


def _newest_files(spark: SparkSession, path: str) -> DataFrame:
    """(date, newest): when the last data file of each partition was written, from the file listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    date = F.regexp_extract("path", rf"/{PART_COL}=([^/]+)/", 1)
    return files.select(date.alias("d"), "modificationTime").where("d <> ''").groupBy("d").agg(F.max("modificationTime").alias("newest"))


def compact(spark: SparkSession, path: str, older_than, segment_by=("gpu_uuid", "hostname"),
            time_col: str = "time") -> list:
    """Rewrite cold partitions clustered by device, newest first (SNK9), so parquet
    row-group min/max statistics prune device and time predicates. Returns their dates.

    A log beside the table notes each compacted partition with its newest file; it is done
    again only if a data file is newer than that. Range partitioning on (date, device, time) uses
    sampled boundaries, so a device holding a third of a day's rows is split across tasks.
    """
    replay(spark, path)
    df, log = spark.read.parquet(path), f"{path.rstrip('/')}-compacted"
    cold = [r[0] for r in df.where(F.col(PART_COL) < F.to_date(F.lit(str(older_than)).cast("timestamp")))
            .select(PART_COL).distinct().collect()]
    done = read_or_none(spark, log)
    if done is not None:
        same = _newest_files(spark, path).join(done, ["d", "newest"], "left_semi")
        kept = {r.d for r in same.select("d").collect()}
        cold = [d for d in cold if str(d) not in kept]
    cold = sorted(cold)
    if cold:
        rows = df.where(F.col(PART_COL).isin(cold)).repartitionByRange(PART_COL, *segment_by, time_col)
        _replace(rows.sortWithinPartitions(PART_COL, *segment_by, F.col(time_col).desc()), path, PART_COL, cold)
        _newest_files(spark, path).where(F.col("d").isin([str(d) for d in cold])).write.mode("append").parquet(log)
    return cold


def refresh_frame(metrics: DataFrame, level: str, as_of, start_offset: str, end_offset: str) -> DataFrame:
    """Rollup rows a continuous-aggregate refresh produces (SNK10), without writing.

    Buckets are recomputed for every day touched by ``[as_of - start_offset,
    as_of - end_offset)`` and kept only when complete before the end bound, so
    the newest, still-filling bucket is held back as the stream would hold it.
    """
    from fleetscope.operators.rollups import rollup_level
    a = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")
    lo = a - F.expr(f"INTERVAL {start_offset}")
    hi = a - F.expr(f"INTERVAL {end_offset}")
    day_lo = F.to_date(lo).cast("timestamp")
    src = metrics.where((F.col("time") >= day_lo) & (F.col("time") < hi))
    if PART_COL in metrics.columns:
        src = src.where((F.col(PART_COL) >= F.to_date(lo)) & (F.col(PART_COL) <= F.to_date(hi)))
    every = {"1min": 60, "5min": 300, "1hour": 3600, "1day": 86400}[level]
    r = rollup_level(src, level)
    return with_date(r.where(F.col("time") + F.make_interval(secs=F.lit(every)) <= hi))


def refresh_rollup(metrics: DataFrame, path: str, level: str, as_of, start_offset: str, end_offset: str) -> None:
    """Continuous-aggregate refresh (SNK10): recompute and exchange the touched days.

    Whole ``date`` partitions are exchanged, so the refresh recomputes every bucket of
    each touched day up to the end bound.
    """
    out = refresh_frame(metrics, level, as_of, start_offset, end_offset)
    replay(out.sparkSession, path)
    _replace(out, path, PART_COL)


def log_invalid(rows: DataFrame, log: str, every: str, batch_id: int, time_col: str = "time") -> None:
    """Note the buckets that newly stored ``rows`` touch (SNK10); a repeated batch id replaces its own note."""
    from fleetscope.operators.rollups import bucket
    touched = rows.select(bucket(time_col, every).alias("time")).distinct().withColumn("batch_id", F.lit(batch_id))
    touched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(log)


def invalid_frame(metrics: DataFrame, buckets: DataFrame, level: str) -> DataFrame:
    """Rollup rows of the named buckets (time) only, recomputed from ``metrics``."""
    from fleetscope.operators.rollups import LEVELS, bucket, rollup_level
    every = LEVELS[level][0]
    due = metrics.withColumn("_bucket", bucket("time", every)).join(buckets.select(F.col("time").alias("_bucket")).distinct(), "_bucket", "left_semi")
    return with_date(rollup_level(due.drop("_bucket"), level))


def refresh_invalid(spark: SparkSession, metrics_path: str, path: str, log: str, level: str) -> int:
    """Recompute the buckets noted in ``log`` and no others (SNK10); returns how many there were.

    Only the days concerned are read, and of these only the rows of the noted buckets are added up;
    the other buckets of a day keep their stored rows. Notes are removed at the end, so a refresh
    that was cut short is done again.
    """
    replay(spark, path)
    notes = read_or_none(spark, log)
    if notes is None:
        return 0
    batches = [r[0] for r in notes.select("batch_id").distinct().collect()]
    with staged(notes.where(F.col("batch_id").isin(batches)).select("time").distinct()) as buckets:
        days = [r[0] for r in buckets.select(F.to_date("time")).distinct().collect()]
        fresh = invalid_frame(spark.read.parquet(metrics_path).where(F.col(PART_COL).isin(days)), buckets, level)
        stored = read_or_none(spark, path)
        if stored is not None:
            kept = stored.where(F.col(PART_COL).isin(days)).join(buckets, "time", "left_anti")
            fresh = fresh.unionByName(kept.select(*fresh.columns))
        _replace(fresh, path, PART_COL, days)
        n = buckets.count()
    _drop_partitions(spark, log, "batch_id", batches)
    return n


ANOMALY_KEYS = ("time", "gpu_uuid", "anomaly_type")


def acknowledge_frame(stored: DataFrame, keys_df: DataFrame, by: str, as_of: Column) -> DataFrame:
    """``stored`` with the named anomalies marked acknowledged (SNK11), without writing."""
    named = keys_df.select(*ANOMALY_KEYS).distinct().withColumn("_named", F.lit(True))
    d = stored.join(named, list(ANOMALY_KEYS), "left")
    hit = F.col("_named").isNotNull()
    return d.withColumns({"acknowledged": hit | F.coalesce(F.col("acknowledged"), F.lit(False)),
                          "acknowledged_at": F.when(hit, as_of).otherwise(F.col("acknowledged_at")),
                          "acknowledged_by": F.when(hit, F.lit(by)).otherwise(F.col("acknowledged_by"))}).select(*stored.columns)


def acknowledge(spark: SparkSession, path: str, keys_df: DataFrame, by: str, as_of) -> None:
    """Mark anomalies acknowledged (SNK11); only the dates of the named keys are read and rewritten."""
    replay(spark, path)
    dates = [r[0] for r in keys_df.select(F.to_date("time")).distinct().collect()]
    stored = spark.read.parquet(path).where(F.col(PART_COL).isin(dates))
    _replace(acknowledge_frame(stored, keys_df, by, F.lit(str(as_of)).cast("timestamp")), path, PART_COL)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export of a range (SRC7)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def import_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV import with an explicit schema, never inferred (SRC7)."""
    return spark.read.schema(schema).option("header", True).csv(path)

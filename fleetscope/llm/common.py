"""Shared helpers: shared-folder tables, crc folds, file systems, row filters."""

from __future__ import annotations

import bisect
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null id: null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(parts)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Keep Arrow batches of whole texts small, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def file_system(uri: str):
    """(pyarrow file system, path) of a shared-folder URI; plain paths are local."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def commit_bytes(filesystem, tmp_dir: str, final: str, data: bytes) -> None:
    """Write under a name of this attempt's own, then rename into place.

    A retried or speculative attempt renames identical bytes over the same name.
    """
    tmp = f"{tmp_dir}/{uuid.uuid4().hex}"
    with filesystem.open_output_stream(tmp, compression=None) as out:
        out.write(data)
    filesystem.move(tmp, final)


def id_key(c: Column) -> list[Column]:
    """Ascending sort key of an id with nulls last, for use inside ``struct``."""
    return [c.isNull(), c]


def shard_bounds(docs: DataFrame, id_col: str, weight: Column, target: int,
                 max_shards: int = 20_000, per_shard: int = 20) -> list:
    """Ascending ids that cut ``docs`` into shards of about ``target`` weight each.

    Deterministic: the ids examined are those with the smallest hashes classes
    (``xxhash64(id) mod m``), with ``m`` chosen so that about ``per_shard`` of them
    fall in each shard; the driver receives at most about
    ``max_shards * per_shard`` ids. The split depends on the rows alone, not on
    their partitioning.
    """
    n, total = docs.agg(F.count(id_col), F.sum(weight)).first()
    shards = int(min(max_shards, max(1, -(-int(total or 0) // target))))
    if shards == 1 or not n:
        return []
    m = max(1, n // (shards * per_shard))
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), weight.cast("double").alias("w"))
    rows = ids.where(F.pmod(F.xxhash64(F.col("i")), F.lit(m)) == 0).collect()
    rows.sort(key=lambda r: r.i)
    whole = sum(r.w for r in rows) or 1.0
    bounds, acc = [], 0.0
    for r in rows:
        if acc >= whole * (len(bounds) + 1) / shards and (not bounds or r.i > bounds[-1]):
            bounds.append(r.i)
        acc += r.w
    return bounds


def shard_column(id_col: Column, bounds: list) -> Column:
    """Number of bounds at or below the id (null ids go to the last shard)."""
    if not bounds:
        return F.lit(0)

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: len(bounds) if i is None or i != i else bisect.bisect_right(bounds, i)).astype("int32")

    return shard(id_col)

"""Bucket totals in a stream: against a batch replay, restarts, TTL, a device with a million rows."""

import datetime as dt
import random

import numpy as np
from fleetscope.streaming import moments
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "time timestamp, gpu_uuid string, gpu_temp double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(spark, src, out, ck, **options):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    moments.bucket_anomalies(stream, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()


def replay(rows, end, z=3.0, ttl=dt.timedelta(days=7)):
    out, buckets = [], {}
    for t, g, x in rows:
        if x is not None:
            buckets.setdefault((g, T0 + (t - T0) // dt.timedelta(minutes=5) * dt.timedelta(minutes=5)), []).append(x)
    states = {}
    for (g, start), xs in sorted(buckets.items()):
        if start + dt.timedelta(minutes=5) > end:
            continue
        (state, last) = states.get(g, ((0, 0.0, 0.0), start))
        if start - last > ttl:
            state = (0, 0.0, 0.0)
        out += [(g, v) for v, _ in moments.judge(state, min(xs), max(xs), z, 2)]
        x = np.array(xs)
        states[g] = moments.absorb(state, len(x), x.mean(), ((x - x.mean()) ** 2).sum()), start
    return sorted(out)


def test_totals_combine():
    x = np.random.default_rng(0).normal(70, 5, 1000)
    state = (0, 0.0, 0.0)
    for part in np.split(x, [1, 7, 400, 999]):
        state = moments.absorb(state, len(part), part.mean(), ((part - part.mean()) ** 2).sum())
    assert state[0] == 1000 and np.isclose(state[1], x.mean()) and np.isclose(state[2], ((x - x.mean()) ** 2).sum())
    assert moments.absorb((0, 0.0, 0.0), 0, 0.0, 0.0) == (0, 0.0, 0.0)


def test_stream_equals_replay_over_restarts(spark, tmp_path_str):
    rnd = random.Random(1)
    src, out, ck = (f"{tmp_path_str}/{x}" for x in ("src", "out", "ck"))
    rows, t = [], T0
    for k in range(900):
        t += dt.timedelta(seconds=rnd.choice([10, 60, 200]))
        if k == 500:
            t += dt.timedelta(days=9)  # beyond the TTL: every device starts anew
        rows.append((t, f"G{k % 3}", None if k % 50 == 7 else 95.0 if k in (300, 480, 700) else 60 + rnd.random() * 4))
    last = rows[-1][0] + dt.timedelta(hours=2)
    for chunk in (rows[:400], rows[400:700], rows[700:] + [(last, "end", 1.0)]):
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        drain(spark, src, out, ck)
    got = sorted((r.gpu_uuid, r.value) for r in spark.read.parquet(out).collect())
    assert got == replay(rows, last - dt.timedelta(hours=1)) and len(got) >= 3


def test_a_million_rows_of_one_device_in_a_batch(spark, tmp_path_str):
    src, out, ck = (f"{tmp_path_str}/{x}" for x in ("src", "out", "ck"))
    n = 1_000_000
    spike = F.when(F.col("id") == 900_000, 200.0).otherwise(60 + F.pmod(F.xxhash64("id"), F.lit(100)) / 25)
    df = spark.range(0, n, 1, 8).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") / 10).alias("time"), F.lit("hot").alias("gpu_uuid"), spike.alias("gpu_temp"))
    df.write.parquet(src)
    drain(spark, src, out, ck)
    totals = moments.bucket_totals(spark.read.parquet(src))
    assert totals.count() == -(-n // 3000) and totals.agg(F.sum("n")).first()[0] == n
    assert [(r.gpu_uuid, r.value) for r in spark.read.parquet(out).where("value > 100").collect()] == [("hot", 200.0)]

"""The as-of join against brute force: many events per key, keys over many partitions, ties, nulls."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetscope.operators.asof import asof_join

T0 = dt.datetime(2024, 1, 1)


def make(seed):
    rnd = random.Random(seed)
    time = lambda: T0 + dt.timedelta(minutes=rnd.randrange(400))
    sizes = {"hot": (300, 120), "rows only": (20, 0), "events only": (0, 20), None: (6, 5), "one": (1, 1), **{f"d{i:02d}": (i % 5, i % 3) for i in range(25)}}
    rows = [(k, time(), i) for k, (n, _) in sizes.items() for i in range(n)]
    events = [(k, t, f"{k}{t}") for k, (_, m) in sizes.items() for t in {time() for _ in range(m)}]
    rnd.shuffle(rows), rnd.shuffle(events)
    return rows, events


def brute(rows, events, same_is_last):
    out = []
    for k, t, v in rows:
        mine = sorted(e[1:] for e in events if e[0] == k)
        last = [e for e in mine if e[0] < t or (same_is_last and e[0] == t)]
        after = [e for e in mine if e[0] > t or (not same_is_last and e[0] == t)]
        out.append((k, t, v, last[-1][1] if last else None, after[0][1] if after else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions, batch", [(1, 10_000), (8, 5), (60, 3), (8, 1)])
@pytest.mark.parametrize("same_is_last", [True, False])
def test_matches_bruteforce(spark, partitions, batch, same_is_last):
    rows, events = make(partitions + batch)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = asof_join(spark.createDataFrame(rows, "gpu_uuid string, time timestamp, v int").repartition(3), spark.createDataFrame(events, "gpu_uuid string, time timestamp, name string"),
                        same_time_is_last=same_is_last)
        assert got.columns == ["gpu_uuid", "time", "v", "last_event", "next_event"]
        found = got.select("gpu_uuid", "time", "v", "last_event.name", F.col("next_event.name").alias("n")).collect()
        assert sorted(map(tuple, found), key=repr) == brute(rows, events, same_is_last)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_key_with_very_many_rows_and_events_spreads_out(spark):
    rows = spark.range(30_000).select(F.lit("hot").alias("gpu_uuid"), F.timestamp_seconds(F.col("id") * 10).alias("time"), "id")
    events = spark.range(3_000).select(F.lit("hot").alias("gpu_uuid"), F.timestamp_seconds(F.col("id") * 100 + 5).alias("time"), F.col("id").alias("e"))
    got = asof_join(rows, events)
    bad = got.where("NOT last_event.e <=> if(id * 10 < 5, null, (id * 10 - 5) div 100) OR NOT next_event.e <=> if((id * 10 + 95) div 100 >= 3000, null, (id * 10 + 95) div 100)")
    assert bad.count() == 0 and got.count() == 30_000
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 15_000


def test_long_stretches_without_events(spark):
    rows = spark.range(5_000).select(F.lit("k").alias("gpu_uuid"), F.timestamp_seconds("id").alias("time"))
    events = spark.createDataFrame([("k", dt.datetime(1970, 1, 1), "a"), ("k", dt.datetime(1970, 1, 2), "z")], "gpu_uuid string, time timestamp, name string")
    got = asof_join(rows, events).select("last_event.name", F.col("next_event.name").alias("n")).distinct().collect()
    assert [tuple(r) for r in got] == [("a", "z")]


def test_empty_sides(spark):
    rows, events = make(1)
    r = spark.createDataFrame(rows, "gpu_uuid string, time timestamp, v int")
    e = spark.createDataFrame(events, "gpu_uuid string, time timestamp, name string")
    assert asof_join(r.limit(0), e).count() == 0
    assert asof_join(r, e.limit(0)).where("last_event IS NULL AND next_event IS NULL").count() == len(rows)

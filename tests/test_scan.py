"""The ordered scan against brute force: keys that span many partitions, ties, nulls."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetscope.operators.design import interpolate_grid
from fleetscope.operators.scan import with_neighbours

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "gpu_uuid string, time timestamp, v double, other int"


def make(sizes, seed=1):
    rnd = random.Random(seed)
    rows = []
    for dev, n in sizes:
        t = T0
        for _ in range(n):
            t += dt.timedelta(seconds=rnd.choice([1, 10, 4000]))
            rows.append((dev, t, rnd.choice([None, rnd.random()]), rnd.randrange(9)))
    rnd.shuffle(rows)
    return rows


def brute(rows, back, ahead):
    out, by = [], {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for dev, rs in by.items():
        rs.sort(key=lambda r: r[1])
        for i, r in enumerate(rs):
            at = lambda k: rs[k][2] if 0 <= k < len(rs) else None
            out.append((dev, r[1], r[2], i, *[at(i - k) for k in range(1, back + 1)], *[at(i + k) for k in range(1, ahead + 1)]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions, batch", [(1, 10_000), (8, 7), (40, 3), (8, 1)])
@pytest.mark.parametrize("back, ahead", [(0, 0), (1, 0), (0, 1), (2, 2), (5, 3)])
def test_neighbours_match_bruteforce(spark, partitions, batch, back, ahead):
    rows = make([("hot", 150), ("a", 9), ("b", 1), ("c", 2), (None, 12), *[(f"d{i:02d}", i % 4) for i in range(20)]])
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        got = with_neighbours(df, ["v"], back, ahead)
        names = [f"v_m{k}" for k in range(1, back + 1)] + [f"v_p{k}" for k in range(1, ahead + 1)]
        assert sorted((tuple(r) for r in got.select("gpu_uuid", "time", "v", "row_index", *names).collect()), key=repr) == brute(rows, back, ahead)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_key_spans_partitions_and_the_shuffle_is_shared(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("gpu_uuid"), F.timestamp_seconds(F.col("id") * 7).alias("time"), F.col("id").cast("double").alias("v"))
    got = with_neighbours(df, ["v"], 2, 1)
    assert got.where("row_index <> v OR NOT v_m1 <=> nullif(v, 0) - 1 OR NOT v_m2 <=> if(v < 2, null, v - 2) OR NOT v_p1 <=> if(v = 19999, null, v + 1)").count() == 0
    rows = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 1 and max(r["count"] for r in rows) < 10_000
    got.write.format("noop").mode("overwrite").save()
    plan = got._jdf.queryExecution().executedPlan()
    got.collect()
    text = plan.toString()
    assert len(re.findall("rangepartitioning", text)) >= 1 and "Window" not in text and "SortMergeJoin" not in text


def test_ties_are_ordered_alike_on_both_sides(spark):
    rows = [("k", T0 + dt.timedelta(seconds=i // 9), float(i), i) for i in range(90)]
    got = with_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(7), ["other"], 1, 1).collect()
    assert sorted(r.row_index for r in got) == list(range(90))
    by = {r.row_index: r for r in got}
    assert all(by[i].other_m1 == by[i - 1].other and by[i - 1].other_p1 == by[i].other for i in range(1, 90))
    assert [by[i].time for i in range(90)] == sorted(r[1] for r in rows)


def test_empty_and_any_key(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert with_neighbours(df, ["v"], 1, 1).count() == 0
    by_number = spark.createDataFrame([(3, 1, "x"), (3, 2, "y"), (4, 1, "z")], "k long, t int, s string")
    got = with_neighbours(by_number, ["s", "t"], 1, 1, "k", "t").orderBy("k", "t").select("s_m1", "s_p1", "t_m1", "t_p1").collect()
    assert [tuple(r) for r in got] == [(None, "y", None, 2), ("x", None, 1, None), (None, None, None, None)]


def test_grid_with_buckets_without_values(spark):
    hour = lambda h: T0 + dt.timedelta(hours=h)
    rows = [("a", hour(0), None, 0), ("a", hour(2), 10.0, 0), ("a", hour(3), None, 0), ("a", hour(6), 30.0, 0), ("a", hour(8), None, 0),
            ("b", hour(1), None, 0), ("b", hour(3), None, 0), ("c", hour(5), 1.0, 0)]
    got = {(r.gpu_uuid, r.time): (r.value, r.interpolated) for r in interpolate_grid(spark.createDataFrame(rows, SCHEMA), "v").collect()}
    want = {("a", hour(0)): (None, True), ("a", hour(1)): (None, True), ("a", hour(2)): (10.0, False), ("a", hour(3)): (15.0, True), ("a", hour(4)): (20.0, True),
            ("a", hour(5)): (25.0, True), ("a", hour(6)): (30.0, False), ("a", hour(7)): (None, True), ("a", hour(8)): (None, True),
            ("b", hour(1)): (None, True), ("b", hour(2)): (None, True), ("b", hour(3)): (None, True), ("c", hour(5)): (1.0, False)}
    assert got == want

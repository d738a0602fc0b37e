"""List prices, the decision ladder and stored sketches."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from fleetscope.operators import pricing, sketches

T0 = dt.datetime(2024, 1, 1)


def pending(spark, n=20):
    rows = [(f"G{i:02d}", "m" if i < n - 1 else "lone", 100.0 - i, 10_000.0, 20_000.0, 1_000.0, i % 2 == 0, 1.0, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "gpu_uuid string, model string, health_score double, base_price double, new_price double, salvage_value double, "
                                       "under_warranty boolean, urgency_factor double, demand_factor double")


def test_bulk_discount_by_count_and_by_place(spark):
    plain = {r.gpu_uuid: r for r in pricing.list_prices(pending(spark)).collect()}
    assert plain["G00"].pending == 19 and plain["G00"].bulk_factor == 0.85 and plain["G19"].bulk_factor == 0.99
    assert plain["G00"].list_price == 10_700.0 and plain["G00"].min_acceptable == 9_600.0  # 10000 * 1.2 * 0.85 + 500
    queue = {r.gpu_uuid: r for r in pricing.list_prices(pending(spark), progressive=True).collect()}
    assert [queue[f"G{i:02d}"].pending for i in range(19)] == list(range(1, 20)) and queue["G19"].pending == 1
    assert queue["G00"].bulk_factor == 0.99 and queue["G18"].bulk_factor == 0.85


def test_price_bounds(spark):
    d = pending(spark, 2).withColumn("base_price", F.lit(1.0)).withColumn("under_warranty", F.lit(False))
    assert {r.list_price for r in pricing.list_prices(d).collect()} == {1200.0}
    assert {r.list_price for r in pricing.list_prices(d.withColumn("base_price", F.lit(1e9))).collect()} == {17_000.0}


def test_ladder_takes_the_first_rung(spark):
    rows = [("a", 90.0, 400, 9.0, 1.0, 1.0), ("b", 90.0, 300, 9.0, 1.0, 1.0), ("c", 90.0, 100, 9.0, 1.0, 1.0), ("d", 60.0, 400, 1.0, 2.0, 1.0), ("e", 45.0, 400, 9.0, 1.0, 9.0), ("f", 30.0, 400, 9.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "gpu_uuid string, health_score double, lifetime_days int, market_value double, repair_cost double, decommission_value double")
    d = d.withColumns({"transaction_cost": F.lit(0.5), "repurpose_value": F.lit(5.0), "salvage_value": F.lit(0.25)})
    got = [(r.action, r.detail, r.expected_value) for r in pricing.decision_ladder(d).orderBy("gpu_uuid").collect()]
    assert got == [("KEEP_PRODUCTION", "HIGH_UTILIZATION", None), ("KEEP_PRODUCTION", "MEDIUM_UTILIZATION", None), ("SELL_SECONDARY", None, 8.5),
                   ("REPURPOSE", "low_criticality_inference", None), ("DECOMMISSION", None, 0.25), ("DECOMMISSION", None, 0.25)]


def samples(spark, n=60_000):
    return spark.range(n).select((F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=(F.col("id") * 10).cast("decimal(18,6)"))).alias("time"),
                                 F.concat(F.lit("G"), F.pmod(F.xxhash64("id"), F.lit(300))).alias("gpu_uuid"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)) / 100).alias("gpu_temp"))


def check(spark, stored):
    rows = samples(spark).select("time", "gpu_uuid", "gpu_temp").toPandas()
    whole = sketches.estimates(sketches.merged(stored, [])).first()
    assert whole.event_count == len(rows) and abs(whole.gpu_count - 300) <= 15 and abs(whole.gpu_count_theta - 300) <= 15
    for name, q in sketches.QUANTILES.items():
        v = getattr(whole, name)
        assert (rows.gpu_temp < v).mean() - 0.02 <= q <= (rows.gpu_temp <= v).mean() + 0.02
    daily = sketches.estimates(sketches.merged(stored, [F.to_date("time").alias("day")])).collect()
    assert sum(r.event_count for r in daily) == len(rows)
    for r in daily:
        mine = np.sort(rows[rows.time.dt.date == r.day].gpu_temp.to_numpy())
        assert abs(np.searchsorted(mine, r.p95) / len(mine) - 0.95) < 0.03


def test_stored_sketches_merge_for_any_window(spark, tmp_path_str):
    sketches.sketch_rollup(samples(spark), "1 hour").write.parquet(tmp_path_str + "/s")
    check(spark, spark.read.parquet(tmp_path_str + "/s"))


def test_the_same_table_from_a_stream(spark, tmp_path_str):
    src, out = tmp_path_str + "/src", tmp_path_str + "/out"
    end = spark.createDataFrame([(T0 + dt.timedelta(days=30), "end", 0.0)], "time timestamp, gpu_uuid string, gpu_temp double")
    samples(spark).repartition(3).write.parquet(src)
    end.write.mode("append").parquet(src)  # closes every bucket before it
    stream = spark.readStream.schema(end.schema).parquet(src).withWatermark("time", "1 hour")
    sketches.sketch_rollup(stream, "1 hour").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", tmp_path_str + "/ck") \
        .trigger(availableNow=True).start().awaitTermination()
    check(spark, spark.read.parquet(out))

"""Table maintenance: replay idempotence, upserts, deletes, retention, refresh."""

import datetime as dt

from pyspark.sql import functions as F

from fleetscope.operators import tables

T0 = dt.datetime(2024, 1, 1)


def frame(spark, n=50, days=5, v=1.0):
    rows = [(T0 + dt.timedelta(hours=i * 24 * days / n), f"G{i % 3}", v * i) for i in range(n)]
    return spark.createDataFrame(rows, "time timestamp, gpu_uuid string, value double")


def test_append_ignore_replay(spark, tmp_path_str):
    p = tmp_path_str + "/m"
    df = frame(spark)
    tables.append_ignore(df, p, ["time", "gpu_uuid"])
    tables.append_ignore(df.union(df), p, ["time", "gpu_uuid"])  # replay + in-batch duplicates
    assert spark.read.parquet(p).count() == 50


def test_upsert_partial(spark, tmp_path_str):
    p = tmp_path_str + "/d"
    base = frame(spark).withColumn("note", F.lit("a"))
    tables.upsert(base, p, ["time", "gpu_uuid"])
    upd = frame(spark, v=2.0).limit(10).withColumn("note", F.lit("b"))
    tables.upsert(upd, p, ["time", "gpu_uuid"], update_cols=["value"])
    got = spark.read.parquet(p)
    assert got.count() == 50
    assert got.where("note = 'b'").count() == 0  # note not in update_cols: kept
    assert got.where("value IS NULL").count() == 0  # rows without an update keep their values
    orig = {(r.time, r.gpu_uuid): r.value for r in base.collect()}
    new = {(r.time, r.gpu_uuid): r.value for r in upd.collect()}
    for r in got.collect():
        assert r.value == new.get((r.time, r.gpu_uuid), orig[(r.time, r.gpu_uuid)])


def test_delete_and_retention(spark, tmp_path_str):
    p = tmp_path_str + "/r"
    tables.append(frame(spark), p)
    tables.delete_where(spark, p, F.col("gpu_uuid") == "G0")
    assert spark.read.parquet(p).where("gpu_uuid = 'G0'").count() == 0
    dropped = tables.apply_retention(spark, p, 2, "2024-01-05 12:00:00")
    assert len(dropped) == 2
    assert spark.read.parquet(p).agg(F.min("date")).first()[0] == dt.date(2024, 1, 3)


def test_refresh_rollup_complete_buckets(spark, tmp_path_str):
    rows = [(T0 + dt.timedelta(seconds=10 * i), "G", "h", 50.0 + i % 7, 60.0, 300.0, 40.0, 20.0, 1, 0)
            for i in range(1000)]
    m = spark.createDataFrame(rows, "time timestamp, gpu_uuid string, hostname string, gpu_temp double, "
                                    "memory_temp double, power_usage double, sm_active double, "
                                    "memory_utilization double, ecc_sbe_volatile int, ecc_dbe_volatile int")
    as_of = T0 + dt.timedelta(seconds=10 * 999)
    tables.refresh_rollup(m, tmp_path_str + "/r5", "5min", as_of, "30 days", "1 minute")
    out = spark.read.parquet(tmp_path_str + "/r5")
    assert out.agg(F.sum("sample_count")).first()[0] <= 1000
    assert out.count() == int((10 * 999 - 60) // 300)  # only buckets closed before as_of - 1 min


def test_compact_preserves_rows(spark, tmp_path_str):
    p = tmp_path_str + "/c"
    df = frame(spark, n=200).withColumn("hostname", F.lit("h"))
    tables.append(df, p)
    before = sorted(tuple(r) for r in spark.read.parquet(p).select("time", "gpu_uuid", "value").collect())
    done = tables.compact(spark, p, "2024-01-04")
    got = spark.read.parquet(p)
    assert len(done) == 3 and tables.compact(spark, p, "2024-01-04") == []  # marked: not done again
    assert sorted(tuple(r) for r in got.select("time", "gpu_uuid", "value").collect()) == before


def test_acknowledge_and_csv_roundtrip(spark, tmp_path_str):
    p = tmp_path_str + "/a"
    an = spark.createDataFrame(
        [(T0, "G0", "temperature", 99.0, False, None, None), (T0, "G1", "power_usage", 500.0, False, None, None)],
        "time timestamp, gpu_uuid string, anomaly_type string, value double, acknowledged boolean, "
        "acknowledged_at timestamp, acknowledged_by string")
    tables.append(an, p)
    keys = spark.createDataFrame([(T0, "G0", "temperature")], "time timestamp, gpu_uuid string, anomaly_type string")
    tables.acknowledge(spark, p, keys, "oncall", "2024-01-02 00:00:00")
    got = {r.gpu_uuid: r for r in spark.read.parquet(p).collect()}
    assert got["G0"].acknowledged and got["G0"].acknowledged_by == "oncall" and got["G0"].value == 99.0
    assert not got["G1"].acknowledged and got["G1"].acknowledged_by is None
    out = tmp_path_str + "/csv"
    tables.export_csv(spark.read.parquet(p).drop("date"), out)
    back = tables.import_csv(spark, out, an.schema)
    assert back.count() == 2


def test_first_row_of_a_batch_wins(spark, tmp_path_str):
    p = tmp_path_str + "/f"
    rows = [(T0, f"G{i % 5}", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "time timestamp, gpu_uuid string, value double").coalesce(1)
    tables.append_ignore(df, p, ["time", "gpu_uuid"])
    assert sorted(r.value for r in spark.read.parquet(p).collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_input_is_evaluated_once(spark, tmp_path_str):
    p = tmp_path_str + "/once"
    seen = spark.sparkContext.accumulator(0)

    def tick(frames):
        for f in frames:
            seen.add(len(f))
            yield f
    base = frame(spark)
    tables.append(base, p)
    tables.append_ignore(base.mapInPandas(tick, base.schema), p, ["time", "gpu_uuid"])
    assert seen.value == 50


def test_upsert_moves_a_key_whose_date_changes(spark, tmp_path_str):
    p = tmp_path_str + "/move"
    day = lambda d, v: spark.createDataFrame([("G0", dt.datetime(2024, 1, d), v)], "gpu_uuid string, time timestamp, v int")
    other = spark.createDataFrame([("G1", dt.datetime(2024, 1, 1), 9)], "gpu_uuid string, time timestamp, v int")
    tables.upsert(day(1, 1).union(other), p, ["gpu_uuid"])
    tables.upsert(day(2, 2), p, ["gpu_uuid"])
    assert sorted((r.gpu_uuid, r.v, str(r.date)) for r in spark.read.parquet(p).collect()) == [
        ("G0", 2, "2024-01-02"), ("G1", 9, "2024-01-01")]


def test_dimension_upsert_without_time(spark, tmp_path_str):
    p = tmp_path_str + "/dim"
    schema = "gpu_uuid string, model string, rack string, updated_at timestamp"
    tables.upsert(spark.createDataFrame([("G0", "a", "r0", T0), ("G1", "b", "r1", T0)], schema), p, ["gpu_uuid"], part_col=None)
    late = T0 + dt.timedelta(days=1)
    tables.upsert(spark.createDataFrame([("G1", "c", "r9", None), ("G2", "d", "r2", None)], schema), p, ["gpu_uuid"],
                  update_cols=["rack"], updated_at=F.lit(late), part_col=None)
    got = sorted(tuple(r) for r in spark.read.parquet(p).collect())
    assert got == [("G0", "a", "r0", T0), ("G1", "b", "r9", late), ("G2", "d", "r2", late)]


def interrupted(monkeypatch, spark, path, part_col, then):
    """Upsert key G0 from date 1 to date 2 but stop before anything is put in place; then ``then`` and the next operation."""
    day = lambda d, v: spark.createDataFrame([("G0", dt.datetime(2024, 1, d), v)], "gpu_uuid string, time timestamp, v int")
    tables.upsert(day(1, 1), path, ["gpu_uuid"], part_col=part_col)
    tables.upsert(spark.createDataFrame([("G1", dt.datetime(2024, 1, 2), 9)], "gpu_uuid string, time timestamp, v int"), path, ["gpu_uuid"], part_col=part_col)
    with monkeypatch.context() as m:
        m.setattr(tables, "replay", lambda *a: None)
        tables.upsert(day(2, 2), path, ["gpu_uuid"], part_col=part_col)
    then()
    tables.replay(spark, path)
    tables.replay(spark, path)
    assert not tables._exists(spark, tables._pending(path))
    return sorted((r.gpu_uuid, r.v) for r in spark.read.parquet(path).collect())


def test_interrupted_upsert_is_finished_whatever_was_done(spark, tmp_path_str, monkeypatch):
    for part_col in ("date", None):
        def at(name):
            return f"{tmp_path_str}/{name}-{part_col}"  # noqa: B023

        assert interrupted(monkeypatch, spark, at("complete"), part_col, lambda: None) == [("G0", 2), ("G1", 9)]
        # the process ended while the new files went in: one partition is there, the other not
        half = lambda: spark.read.parquet(at("half") + "-pending/rows").limit(1).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(*([part_col] if part_col else [])).parquet(at("half"))  # noqa: B023
        assert interrupted(monkeypatch, spark, at("half"), part_col, half) == [("G0", 2), ("G1", 9)]
        # ... or before the pending folder was complete: the upsert never took place
        cut = lambda: tables._delete(spark, at("cut") + "-pending/rows/_SUCCESS")
        assert interrupted(monkeypatch, spark, at("cut"), part_col, cut) == [("G0", 1), ("G1", 9)]


def test_partitions_without_a_value(spark, tmp_path_str):
    p = tmp_path_str + "/nulls"
    schema = "gpu_uuid string, site string, v int"
    tables.upsert(spark.createDataFrame([("G0", None, 1), ("G1", "a b/c", 1)], schema), p, ["gpu_uuid"], time_col="none", part_col="site")
    tables.upsert(spark.createDataFrame([("G0", "x", 2), ("G1", None, 2)], schema), p, ["gpu_uuid"], time_col="none", part_col="site")
    assert sorted(((r.gpu_uuid, r.site, r.v) for r in spark.read.parquet(p).collect()), key=repr) == [("G0", "x", 2), ("G1", None, 2)]


def test_a_late_row_refreshes_exactly_its_buckets(spark, tmp_path_str):
    m, r, log = (f"{tmp_path_str}/{x}" for x in ("m", "r", "log"))
    schema = ("time timestamp, gpu_uuid string, hostname string, gpu_temp double, memory_temp double, power_usage double, sm_active double, "
              "memory_utilization double, ecc_sbe_volatile int, ecc_dbe_volatile int")
    sample = lambda minute, temp, gpu="G": (T0 + dt.timedelta(minutes=minute), gpu, "h", temp, 60.0, 300.0, 40.0, 20.0, 1, 0)
    first = spark.createDataFrame([sample(k, 50.0) for k in range(0, 2880, 2)], schema)
    tables.append(first, m)
    tables.log_invalid(first, log, "5 minutes", 0)
    assert tables.refresh_invalid(spark, m, r, log, "5min") == 576 and tables.refresh_invalid(spark, m, r, log, "5min") == 0
    # poison what is stored: a bucket that is recomputed shows it
    stored = spark.read.parquet(r)
    tables._replace(stored.withColumn("gpu_temp_max", F.lit(-1.0)), r, "date")
    late = spark.createDataFrame([sample(7, 99.0), sample(1441, 98.0, "H")], schema)
    tables.append(late, m)
    tables.log_invalid(late, log, "5 minutes", 1)
    tables.log_invalid(late, log, "5 minutes", 1)  # the batch again
    assert tables.refresh_invalid(spark, m, r, log, "5min") == 2
    got = {(x.time, x.gpu_uuid): (x.gpu_temp_max, x.sample_count) for x in spark.read.parquet(r).collect()}
    changed = {k: v for k, v in got.items() if v[0] != -1.0}
    at = lambda minute: T0 + dt.timedelta(minutes=minute)
    assert changed == {(at(5), "G"): (99.0, 3), (at(1440), "G"): (50.0, 3), (at(1440), "H"): (98.0, 1)} and len(got) == 577


def test_a_time_range_opens_only_its_days(spark, tmp_path_str):
    p = tmp_path_str + "/range"
    tables.append(frame(spark), p)
    df = tables.read_range(spark, p, "2024-01-02 06:00:00", "2024-01-03 12:00:00", cols=["time", "gpu_uuid"])
    got = sorted(r.time for r in df.collect())
    assert got == sorted(r.time for r in frame(spark).where("time BETWEEN '2024-01-02 06:00:00' AND '2024-01-03 12:00:00'").collect()) and df.columns == ["time", "gpu_uuid"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "GreaterThanOrEqual(time" in plan

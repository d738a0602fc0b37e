"""Exact ratios, grouped folds, failure-type models, the model store."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import training

T0 = dt.datetime(2024, 1, 1)


def labelled(spark, n=1200, seed=1):
    rnd = random.Random(seed)
    rows = [(f"G{rnd.randrange(60):02d}", T0 + dt.timedelta(minutes=i), int(rnd.random() < 0.05), "ab"[i % 7 == 0], rnd.random(), rnd.random()) for i in range(n)]
    return spark.createDataFrame(rows, "gpu_uuid string, time timestamp, label int, model string, x double, y double")


def test_sample_has_the_exact_ratio_and_does_not_depend_on_partitions(spark):
    rows = labelled(spark)
    failed = rows.where("label = 1").count()
    got = training.balanced_sample(rows, 3)
    assert got.where("label = 1").count() == failed and got.where("label = 0").count() == 3 * failed
    pick = lambda d: sorted((r.gpu_uuid, r.time) for r in d.collect())
    assert pick(got) == pick(training.balanced_sample(rows.repartition(7), 3)) != pick(training.balanced_sample(rows, 3, seed=1))
    assert got.distinct().count() == got.count() and got.columns == rows.columns
    per = {(r.model, r.label): r.n for r in training.balanced_sample(rows, 2, stratum="model").groupBy("model", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(per[m, 0] == 2 * per[m, 1] for m in "ab")
    assert training.balanced_sample(rows, 100).count() == rows.count()  # fewer controls than asked for: all of them
    assert training.balanced_sample(rows.where("label = 0")).count() == 0


def test_folds_keep_devices_together_and_spread_failures(spark):
    rows = labelled(spark)
    got = training.grouped_folds(rows, 5)
    assert got.count() == rows.count()
    per = got.groupBy("gpu_uuid").agg(F.countDistinct("fold").alias("n"), F.max("fold").alias("fold"), F.max("label").alias("failed")).collect()
    assert all(r.n == 1 for r in per)
    for failed in (0, 1):
        sizes = [sum(r.failed == failed and r.fold == f for r in per) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_failure_types_and_model_store(spark, tmp_path_str):
    rnd = random.Random(3)
    rows = [(rnd.choice([0.0, 1.0]), rnd.random() if rnd.random() < 0.95 else None, i) for i in range(600)]
    kind = F.when(F.col("a") == 1, "memory").when(F.coalesce("b", F.lit(0.0)) > 0.5, "thermal").otherwise("power")
    df = spark.createDataFrame(rows, "a double, b double, id int").withColumn("failure_type", kind)
    model = training.train_failure_types(df, ["a", "b"], trees=10, depth=4)
    scored = training.predict_types(model, df)
    assert scored.columns == [*df.columns, "predicted_type"] and scored.where("b IS NULL").count() == df.where("b IS NULL").count()
    report = {r.failure_type: r for r in training.type_report(scored).collect()}
    assert set(report) == {"memory", "thermal", "power"} and min(r.f1 for r in report.values()) > 0.95 and sum(r.support for r in report.values()) == 600
    assert training.confusion_matrix(scored).agg(F.sum("n")).first()[0] == 600

    root = tmp_path_str + "/store"
    with pytest.raises(LookupError):
        training.load_model(spark, root)
    training.save_model(spark, model, root, "1.0", "types", ["a", "b"], {"f1": 0.99}, T0)
    training.save_model(spark, training.train_failure_types(df, ["a"], trees=3, depth=2), root, "1.1", "types", ["a"], saved_at=T0 + dt.timedelta(days=1))
    with pytest.raises(ValueError):
        training.save_model(spark, model, root, "1.0", "types", ["a", "b"])
    again, row = training.load_model(spark, root, "1.0")
    key = lambda d: sorted(map(repr, d.collect()))
    assert row.metrics["f1"] == 0.99 and row.features == ["a", "b"] and key(training.predict_types(again, df)) == key(scored)
    assert training.load_model(spark, root, kind="types")[1].version == "1.1"


def test_report_counts_classes_that_were_only_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "failure_type string, predicted_type string")
    got = {r.failure_type: (r.precision, r.recall, r.support) for r in training.type_report(df).collect()}
    assert got == {"a": (1.0, 0.5, 2), "b": (0.0, 0.0, 1), "c": (0.0, None, 0)}

"""Trained failure model (ANA4) and outcome tracking (ANA11)."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fleetscope.operators import design, predict


def labelled(spark, n=400):
    """Feature rows whose failures follow from temperature and uncorrectable errors, with noise."""
    rng = np.random.default_rng(1)
    temp, dbe = rng.normal(75, 8, n), rng.integers(0, 3, n) * (rng.random(n) < 0.2)
    fails = (temp + 12 * dbe + rng.normal(0, 2, n) > 86).astype(int)
    return spark.createDataFrame(pd.DataFrame({
        "gpu_uuid": [f"G{i:04d}" for i in range(n)], "time": pd.Timestamp("2024-01-30"), "gpu_temp_mean": temp,
        "ecc_dbe_event_count": dbe.astype("int32"), "power_usage_mean": rng.normal(300, 30, n), "sm_active_mean": rng.random(n) * 100,
        "thermal_throttle_count": np.zeros(n, "int32"), "ecc_sbe_event_count": np.zeros(n, "int32"), "power_brake_count": np.zeros(n, "int32"),
        "gpu_age_days": np.full(n, 100, "int32"), "label": fails}))


def test_gbt_report_importance_and_predictions(spark):
    f = labelled(spark).cache()
    model, auc, report = predict.train_and_report(f)
    r = {x.label: x for x in report.collect()}
    assert auc > 0.95 and r[1].recall > 0.6 and r[0].precision > 0.85 and r[0].support + r[1].support > 50
    top = predict.top_features(predict.feature_importance(model), 2)
    assert top[0][0] == "gpu_temp_mean" and {k for k, _ in top} == {"gpu_temp_mean", "ecc_dbe_event_count"}
    a = F.lit(dt.datetime(2024, 1, 30, 12)).cast("timestamp")
    p = predict.predict_failures(f.drop("label"), a, model=model).collect()
    assert len(p) == 400 and all(x.model_name == "gbt_v1" and abs(sum(x.feature_importance.values()) - 1) < 1e-6 for x in p)
    late = F.lit(dt.datetime(2024, 2, 2)).cast("timestamp")
    assert predict.predict_failures(f.drop("label"), late, model=model).count() == 0  # no features in the last 24 h


def test_cross_validation(spark):
    scores = predict.cross_validate(labelled(spark, 200).cache(), folds=2)
    assert len(scores) == 2 and min(scores) > 0.75


def test_labels_within_horizon(spark):
    t0 = dt.datetime(2024, 1, 1)
    f = spark.createDataFrame([("A", t0), ("B", t0), ("C", t0)], "gpu_uuid string, time timestamp")
    fails = spark.createDataFrame([("A", dt.date(2024, 1, 10)), ("B", dt.date(2024, 3, 1))], "gpu_uuid string, failure_date date")
    assert {r.gpu_uuid: r.label for r in predict.labels_within_horizon(f, fails, 30).collect()} == {"A": 1, "B": 0, "C": 0}


def test_outcome_confusion(spark):
    t0 = dt.datetime(2024, 1, 1)
    preds = spark.createDataFrame(
        [("A", t0, 0.9), ("B", t0, 0.9), ("C", t0, 0.1), ("D", t0, 0.1)],
        "gpu_uuid string, time timestamp, failure_prob_30d double")
    fails = spark.createDataFrame(
        [("A", dt.date(2024, 1, 10)), ("C", dt.date(2024, 1, 20)), ("D", dt.date(2024, 3, 1))],
        "gpu_uuid string, failure_date date")
    r = design.outcome_confusion(preds, fails, 30, 0.5).collect()[0]
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1)

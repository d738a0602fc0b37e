"""Failure prediction (ANA4): rule-based scores as Column expressions, plus a
gradient-boosted model trained and applied with ``pyspark.ml``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.timewin import as_of_col, window_rows
from fleetscope.operators.asof import asof_join
from fleetscope.operators.health import round_half_up
from fleetscope.operators.latest import latest_per_key
from fleetscope.operators.outcomes import days_between

MODEL_VERSION = "1.0"
# Failure types in tie-break order.
FAILURE_TYPES = ["memory", "thermal", "power", "other"]


def _f(name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def heuristic_p30(temp: Column, throttle: Column, dbe: Column, sbe: Column, age: Column) -> Column:
    """Rule score, capped at 0.95."""
    s = (F.when(temp > 85, 0.4).when(temp > 80, 0.2).when(temp > 75, 0.1).otherwise(0.0)
         + F.when(throttle > 20, 0.3).when(throttle > 10, 0.15).otherwise(0.0)
         + F.when(dbe > 0, 0.5).otherwise(0.0)
         + F.when(sbe > 100, 0.2).otherwise(0.0)
         + F.when(age > 1095, 0.2).when(age > 730, 0.1).otherwise(0.0))
    return F.least(s, F.lit(0.95))


def failure_type(temp: Column, throttle: Column, dbe: Column, sbe: Column, brake: Column) -> Column:
    """argmax over (memory, thermal, power, other), first wins on ties."""
    mem = F.when(dbe > 0, 0.5).otherwise(0.0) + F.when(sbe > 50, 0.3).otherwise(0.0)
    th = F.when(temp > 85, 0.4).otherwise(0.0) + F.when(throttle > 20, 0.4).otherwise(0.0)
    pw = F.when(brake > 10, 0.5).otherwise(0.0)
    top = F.greatest(mem, th, pw)
    other = F.when(top < 0.1, 1.0).otherwise(0.0)
    top = F.greatest(top, other)
    return (F.when(mem == top, "memory").when(th == top, "thermal").when(pw == top, "power").otherwise("other"))


def predictions_from_p30(df: DataFrame, p30: Column, model_name: str, confidence: float, as_of: Column,
                         importance: dict[str, float] | None = None, version: str = MODEL_VERSION) -> DataFrame:
    temp, thr = _f("gpu_temp_mean", 70.0), _f("thermal_throttle_count", 0)
    dbe, sbe, brake = _f("ecc_dbe_event_count", 0), _f("ecc_sbe_event_count", 0), _f("power_brake_count", 0)
    d = df.withColumn("_p30", p30)
    p = F.col("_p30")
    return d.select(
        as_of.alias("time"), "gpu_uuid",
        round_half_up(p * 0.25, 4).alias("failure_prob_7d"),
        round_half_up(p, 4).alias("failure_prob_30d"),
        round_half_up(F.least(p * 2.5, F.lit(0.99)), 4).alias("failure_prob_90d"),
        failure_type(temp, thr, dbe, sbe, brake).alias("predicted_failure_type"),
        F.when(p > 0.1, F.floor(F.lit(30.0) / p)).otherwise(F.lit(365)).cast("int").alias("estimated_ttf_days"),
        F.lit(model_name).alias("model_name"), F.lit(version).alias("model_version"),
        F.lit(confidence).alias("confidence"),
        (F.create_map(*[F.lit(x) for kv in importance.items() for x in kv]) if importance
         else F.lit(None).cast("map<string,double>")).alias("feature_importance"),
        as_of.alias("predicted_at"),
    )


def latest_features(features: DataFrame, as_of: Column, active: str = "24 hours") -> DataFrame:
    """Latest feature row of each device with one since ``as_of - active`` (WIN1, FLT4)."""
    return latest_per_key(window_rows(features, as_of, active, strict=False), "gpu_uuid", "time")


def predict_failures(features: DataFrame, as_of=None, model=None, feature_names=None, active: str = "24 hours", version: str = MODEL_VERSION) -> DataFrame:
    """``gpu_failure_predictions`` rows from the latest features of each device that has
    features since ``as_of - active``.

    Without a model: the rule score (model ``heuristic``, confidence 0.60). With a
    fitted ``PipelineModel`` from ``train_model``: its class-1 probability (model
    ``gbt_v1``, confidence 0.75), NULL features filled with 0; ``version`` is the stored one
    (``training.load_model``) and stands in the rows.
    """
    a = as_of_col(features, as_of)
    f = latest_features(features, a, active)
    if model is None:
        p30 = heuristic_p30(_f("gpu_temp_mean", 70.0), _f("thermal_throttle_count", 0), _f("ecc_dbe_event_count", 0),
                            _f("ecc_sbe_event_count", 0), _f("gpu_age_days", 0))
        return predictions_from_p30(f, p30, "heuristic", 0.60, a)
    from pyspark.ml.functions import vector_to_array
    names = feature_names or _model_features(model)
    scored = model.transform(f.fillna(0, subset=names))
    p30 = vector_to_array(F.col("probability"))[1]
    return predictions_from_p30(scored, p30, "gbt_v1", 0.75, a, feature_importance(model), version)


def feature_importance(model) -> dict[str, float]:
    """Importance of each input of a fitted model (PRJ: ``feature_importance`` column)."""
    return dict(zip(_model_features(model), map(float, model.stages[-1].featureImportances.toArray())))


def top_features(importance: dict[str, float], n: int = 10) -> list[tuple[str, float]]:
    """The ``n`` most important features, largest first (TOP5)."""
    return sorted(importance.items(), key=lambda x: (-x[1], x[0]))[:n]


def _model_features(model) -> list[str]:
    return list(model.stages[0].getInputCols())


def train_model(features: DataFrame, label_col: str = "label", feature_names=None, seed: int = 42):
    """Gradient-boosted trees (depth 5, step 0.1, 100 iterations, subsample 0.8) with
    class weights ``(1-r)/r`` for positives; returns ``(PipelineModel, train AUC)``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from fleetscope.operators.features import STORED_FEATURES
    names = feature_names or [c for c in STORED_FEATURES if c in features.columns]
    d = features.select(*names, F.col(label_col).cast("double").alias("label")).fillna(0, subset=names)
    d = d.select(*[F.col(c).cast("double") for c in names], "label")
    rate = d.agg(F.avg("label")).scalar()
    w = F.when(F.col("label") == 1.0, (1.0 - rate) / F.greatest(rate, F.lit(1e-9))).otherwise(1.0)
    d = d.withColumn("w", w)
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="features"),
        GBTClassifier(maxDepth=5, stepSize=0.1, maxIter=100, subsamplingRate=0.8, weightCol="w", seed=seed),
    ])
    model = pipe.fit(d)
    auc = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(model.transform(d))
    return model, auc


def labels_within_horizon(features: DataFrame, failure_labels: DataFrame, days: int = 30) -> DataFrame:
    """``features`` with ``label`` (a recorded failure within ``days`` after the feature time, [D] label
    join), ``lead_days`` to the next failure, its ``next_failure_type`` and ``days_since_failure``.

    An as-of join: however many failures a device has, each row meets its last and its next one.
    A failure at the row's own time has happened. Without a ``failure_type`` column the type is NULL.
    """
    kind = F.col("failure_type").cast("string") if "failure_type" in failure_labels.columns else F.lit(None).cast("string")
    events = failure_labels.select("gpu_uuid", F.col("failure_date").cast("timestamp").alias("time"), kind.alias("kind"))
    met = asof_join(features, events)
    soon = F.col("next_event.time") <= F.col("time") + F.make_dt_interval(days=F.lit(days))
    return met.select(*features.columns, F.coalesce(soon, F.lit(False)).cast("int").alias("label"), days_between(F.col("time"), F.col("next_event.time")).alias("lead_days"),
                      F.col("next_event.kind").alias("next_failure_type"), days_between(F.col("last_event.time"), F.col("time")).alias("days_since_failure"))


def fold_of(key: str, folds: int, seed: int = 42) -> Column:
    """Fold 0 .. folds - 1 of a row by the hash of its key: reproducible, needs no shuffle, and
    as the hash knows nothing of the label, each fold has its share of failures up to chance."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds))


def classification_report(scored: DataFrame, label_col: str = "label", predicted_col: str = "predicted") -> DataFrame:
    """Precision, recall, f1 and support per class, from one aggregation (ANA4)."""
    y, p = F.col(label_col).cast("int"), F.col(predicted_col).cast("int")
    n = scored.agg(*[F.count_if((y == a) & (p == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    per_class = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"n{c}{c}").alias("hit"), (F.col(f"n0{c}") + F.col(f"n1{c}")).alias("said"),
                                   (F.col(f"n{c}0") + F.col(f"n{c}1")).alias("support")) for c in (0, 1)])
    d = n.select(F.inline(per_class))
    precision, recall = F.try_divide("hit", "said"), F.try_divide("hit", "support")
    return d.select("label", precision.alias("precision"), recall.alias("recall"),
                    F.try_divide(2.0 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")


def predicted_labels(model, rows: DataFrame) -> DataFrame:
    """``rows`` with the fitted model's class in ``predicted``."""
    names = _model_features(model)
    return model.transform(rows.fillna(0, subset=names)).withColumn("predicted", F.col("prediction").cast("int"))


def train_and_report(features: DataFrame, label_col: str = "label", key: str = "gpu_uuid", folds: int = 5, seed: int = 42):
    """Train on all folds but one; (model, train AUC, report on the fold left out)."""
    d = features.withColumn("_fold", fold_of(key, folds, seed))
    model, auc = train_model(d.where("_fold > 0").drop("_fold"), label_col, seed=seed)
    return model, auc, classification_report(predicted_labels(model, d.where("_fold = 0")), label_col)


def cross_validate(features: DataFrame, label_col: str = "label", key: str = "gpu_uuid", folds: int = 5, seed: int = 42) -> list[float]:
    """Accuracy on each fold of a model trained on the others."""
    d = features.withColumn("_fold", fold_of(key, folds, seed))
    out = []
    for k in range(folds):
        model, _ = train_model(d.where(F.col("_fold") != k).drop("_fold"), label_col, seed=seed)
        scored = predicted_labels(model, d.where(F.col("_fold") == k))
        out.append(scored.agg(F.avg((F.col("predicted") == F.col(label_col).cast("int")).cast("double"))).first()[0])
    return out

"""Training sets, failure-type models and the model store (ANA4).

Controls are drawn to an exact ratio and devices dealt into folds by the rank of a hash in
their class. Ranks come from the ordered scan, so neither needs a global sort in one task,
and the same rows give the same sample whatever their partitioning. Models are saved under
a version with a manifest row; scoring names the version it used.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.operators.scan import with_neighbours


def _hash_rank(rows: DataFrame, group: Column, key, seed: int) -> DataFrame:
    """``rows`` with ``_g`` and ``_rank``, the place of a row by the hash of ``key`` within its group."""
    marked = rows.withColumns({"_g": group.cast("string"), "_x": F.xxhash64(F.lit(seed), *key)})
    return with_neighbours(marked, [], key="_g", time_col="_x").withColumnRenamed("row_index", "_rank").drop("_x")


def balanced_sample(rows: DataFrame, ratio: int = 3, label_col: str = "label", key=("gpu_uuid", "time"), stratum: str | None = None, seed: int = 42) -> DataFrame:
    """All failures and exactly ``ratio`` times as many controls, per ``stratum`` if given.

    A stratum with fewer controls than that gives all it has; one without failures gives none.
    """
    group = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    label = F.col(label_col).cast("int")
    wanted = rows.groupBy(group.alias("_s")).agg((F.count_if(label == 1) * ratio).alias("_wanted"))
    controls = _hash_rank(rows.where(label == 0), group, key, seed)
    drawn = controls.join(wanted, controls["_g"] == wanted["_s"]).where(F.col("_rank") < F.col("_wanted"))
    return rows.where(label == 1).unionByName(drawn.select(*rows.columns))


def grouped_folds(rows: DataFrame, folds: int = 5, label_col: str = "label", group_col: str = "gpu_uuid", seed: int = 42) -> DataFrame:
    """``rows`` with ``fold``: all rows of a device share one, and the devices with failures are dealt evenly, as are the others."""
    devices = rows.groupBy(group_col).agg(F.max(F.col(label_col).cast("int")).alias("_failed"))
    dealt = _hash_rank(devices, F.col("_failed"), [group_col], seed).select(F.col(group_col).alias("_d"), F.pmod("_rank", F.lit(folds)).cast("int").alias("fold"))
    return rows.join(dealt, rows[group_col].eqNullSafe(dealt["_d"])).drop("_d")


def train_failure_types(rows: DataFrame, feature_names: list[str], type_col: str = "failure_type", trees: int = 100, depth: int = 8, seed: int = 42):
    """Random forest over the recorded failure types; a ``PipelineModel`` whose ``predicted_type`` is a type's name."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
    d = rows.where(F.col(type_col).isNotNull()).select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feature_names], F.col(type_col).alias("_type"))
    labels = StringIndexer(inputCol="_type", outputCol="_label", stringOrderType="alphabetAsc").fit(d)
    stages = [VectorAssembler(inputCols=feature_names, outputCol="_features"),
              RandomForestClassifier(featuresCol="_features", labelCol="_label", predictionCol="_predicted", numTrees=trees, maxDepth=depth, seed=seed),
              IndexToString(inputCol="_predicted", outputCol="predicted_type", labels=labels.labels)]
    return Pipeline(stages=stages).fit(labels.transform(d))


def predict_types(model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``predicted_type``; NULL features count as 0."""
    names = model.stages[0].getInputCols()
    filled = rows.withColumn("_row", F.struct(*rows.columns)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
    return model.transform(filled).select("_row.*", "predicted_type")


def confusion_matrix(scored: DataFrame, label_col: str = "failure_type", predicted_col: str = "predicted_type") -> DataFrame:
    """(actual, predicted, n) of every pair of classes that occurs."""
    return scored.groupBy(F.col(label_col).alias("actual"), F.col(predicted_col).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def type_report(scored: DataFrame, label_col: str = "failure_type", predicted_col: str = "predicted_type") -> DataFrame:
    """Precision, recall, f1 and support per class, also of classes that were only predicted."""
    pairs = confusion_matrix(scored, label_col, predicted_col)
    both = pairs.select(F.inline(F.array(F.struct(F.col("actual").alias("failure_type"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"),
                                                  F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
                                         F.struct(F.col("predicted").alias("failure_type"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))))
    s = both.groupBy("failure_type").agg(F.sum("hit").alias("hit"), F.sum("said").alias("said"), F.sum("support").alias("support"))
    return s.select("failure_type", F.try_divide("hit", "said").alias("precision"), F.try_divide("hit", "support").alias("recall"),
                    F.try_divide(2.0 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")


MANIFEST = "version string, kind string, features array<string>, metrics map<string,double>, saved_at timestamp"


def save_model(spark: SparkSession, model, root: str, version: str, kind: str, features: list[str], metrics: dict[str, float] | None = None,
               saved_at: dt.datetime | None = None) -> None:
    """Store a fitted model under ``version``; a version is written once.

    The manifest row comes last: a model without one was cut short and is not listed.
    """
    if version in {r.version for r in versions(spark, root).collect()}:
        raise ValueError(f"version {version} exists")
    model.write().overwrite().save(f"{root}/models/{version}")
    row = [(version, kind, features, {k: float(v) for k, v in (metrics or {}).items()}, saved_at or dt.datetime.now())]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: one row per stored version."""
    from fleetscope.operators.tables import read_or_none
    found = read_or_none(spark, f"{root}/manifest")
    return spark.createDataFrame([], MANIFEST) if found is None else spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def load_model(spark: SparkSession, root: str, version: str | None = None, kind: str | None = None):
    """(model, manifest row) of a pinned version, or of the newest (of a kind)."""
    from pyspark.ml import PipelineModel
    listed = versions(spark, root)
    listed = listed.where(F.col("version") == version) if version else listed
    listed = listed.where(F.col("kind") == kind) if kind else listed
    row = listed.orderBy(F.desc("saved_at"), F.desc("version")).first()
    if row is None:
        raise LookupError(f"no model {version or kind or ''} in {root}")
    return PipelineModel.load(f"{root}/models/{row.version}"), row

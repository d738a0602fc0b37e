"""op3: personal data in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.pii_votes import KINDS, find_personal_data


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def op3_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(F.col("id").alias("doc_id"), *map(_count, KINDS[:4]), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))

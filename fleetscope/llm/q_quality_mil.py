"""op2: quality score of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.common import fold
from fleetscope.llm.quality_mil import score, train

def held_out() -> Column:
    """Rows whose label is not learnt from."""
    return fold(F.col("doc_id"), 4) == 2


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"),
                                     (F.col("__score") >= 0.7).cast("int").alias("predicted"))

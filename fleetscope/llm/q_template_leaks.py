"""op1: documents that leak benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetscope.llm.template_leaks import find_leaks


def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""op9: license phrases in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.license_index import scan


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")


def op9_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda x: x["base"])
    places = F.flatten(F.transform(base, lambda x: x["places"]))
    rows = found.select("id", "n_words", "found", "score", places.alias("places"), _labels(base).alias("base_labels"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
                       F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
                       "base_labels", _labels(F.col("found")).alias("labels"), "score")

"""op5: the language of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.common import fold
from fleetscope.llm.language_mixture import identify, train

def held_out() -> Column:
    """Rows whose label is not learnt from."""
    return fold(F.col("doc_id"), 3) == 1


def languages(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__language``, learnt from the rows of ``docs`` that are not held out."""
    langs, model = train(docs.where(~held_out()))
    return identify(docs, langs, model)


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = F.col("__language")
    return languages(docs).select("doc_id", held_out().alias("held_out"), found["lang"].alias("lang_pred"),
                                  found["score"].alias("score"), found["langs"].alias("languages"), found["shares"].alias("shares"))

"""Corpus pipeline: five stages over ``documents``, each one operator of the list.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame. ``run`` writes every stage's rows as Parquet into the shared folder and
rereads them as the next stage's documents. All stages but the last keep the columns of
``documents``; the last one returns the pieces of the packed sequences.

Rows that are null in a column pass through the stages as the operators define: null
text is ``und`` and goes in the first stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetscope.llm import exact_dedup, q_bm25_packing, q_language_mixture, simhash_pivots, template_leaks
from fleetscope.llm.common import store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: texts without any language (null, or without a letter) go."""
    found = q_language_mixture.languages(docs)
    return found.where(found["__language"]["lang"] != "und").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one of each group of equal texts stays."""
    return exact_dedup.keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one of each component of near-equal fingerprints stays."""
    return simhash_pivots.keep_rows(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that leak a benchmark item go."""
    return template_leaks.keep_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: what is left, packed into windows."""
    return q_bm25_packing.packed(docs)


STAGES = [
    ("language", language),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: Fingerprints and token ids are beyond SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

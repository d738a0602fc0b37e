"""op10: ``documents`` packed into windows of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetscope.llm.bm25_packing import pack


def packed(docs: DataFrame) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, window=2048)


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))

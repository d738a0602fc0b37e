"""op6: ``documents`` as wavelet-matrix token files, read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetscope.llm.wavelet_tokens import read_tokens, token_files


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root, _ = token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, root)

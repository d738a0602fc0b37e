"""op11: whitened coordinates of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.spectral_whitening import Whitening


def whitened(embeddings: DataFrame) -> DataFrame:
    fit = Whitening(embeddings)
    share = F.array(*[F.lit(e).cast("double") for e in fit.explained()]) if fit.n else F.array().cast("array<double>")
    return fit.transform().select(
        F.col("id").alias("vec_id"), "component", F.lit(fit.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.get(share, F.col("component") - 1).alias("explained"), F.lit(fit.identity_error if fit.n else None).cast("double").alias("identity_error"))


def op11_spectral_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

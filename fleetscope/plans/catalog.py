"""Registered queries: one per operator (or operator group) of the inventory.

Each entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with the
equivalent DuckDB SQL over the driver tables. Keys are the lower-case operator
id plus a short name. Every query reads the whole driver tables.

Floating outputs are rounded to 6 decimals on both sides (``finish`` / ``rnd``),
hiding only summation-order noise.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.plans.oracle import sql

# Windows stretched to the driver data (samples about every 10 h per device over
# 30 days): recent = 1 day, baseline = 30 days, gap threshold = 1 day.
DRIVER_PARAMS = {
    "active": "1 day",
    "recent": "1 day",
    "baseline": "30 days",
    "lookback_days": 30,
    "gap_seconds": 86400,
    "sample_seconds": 36000,
}


@dataclass
class QuerySpec:
    key: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, QuerySpec] = {}


def register(key: str, oracle: str | None, note: str = ""):
    def deco(fn):
        REGISTRY[key] = QuerySpec(key, fn, oracle, note)
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns (summation order differs between engines).

    Rounding goes through DECIMAL(38,12) so decimal ties resolve identically in
    Spark and DuckDB (rounding the raw binary double does not).
    """
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            out.append(F.coalesce(F.round(c.try_cast("decimal(38,12)"), digits).cast("double"),
                                  c.cast("double")).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def rnd(body: str, doubles: list[str], digits: int = 6) -> str:
    """Wrap an oracle body so the listed double columns are rounded like ``finish``."""
    if not doubles:
        return body
    rep = ", ".join(f"coalesce(CAST(round(TRY_CAST({c} AS DECIMAL(38,12)), {digits}) AS DOUBLE), "
                    f"CAST({c} AS DOUBLE)) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) q"

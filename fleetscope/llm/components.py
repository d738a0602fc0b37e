"""Connected components by alternating large-star and small-star steps.

Every step is a join on nodes and an aggregation; each round's links are written to
the shared folder. Nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import store


def _star(links: DataFrame, upward: bool) -> DataFrame:
    """Link each node's larger (upward) or all smaller neighbours to its smallest one."""
    pairs = links.union(links.select("v", "u")) if upward else links.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = pairs.join(low, "u")
    if upward:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v); root is the smallest node reachable."""
    now = store(links.select("u", "v").where("u <> v").distinct(), "cc")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        now = store(_star(_star(now, True), False), "cc")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v")).distinct()

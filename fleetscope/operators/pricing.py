"""List prices of devices that are to be sold, and the health and lifetime ladder (ANA10).

The bulk discount grows with the devices of a model that wait for sale. A device's place in
its model's queue comes from the ordered scan, so a model with most of the fleet is no
single task; the pending count per model is one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.scan import with_neighbours

# Fixed values of the pricing model: discount per pending device and its limit, warranty premium,
# bounds as shares of salvage value and new price, lowest acceptable share.
BULK_STEP, BULK_LIMIT = 0.01, 0.15
WARRANTY_PREMIUM = 500.0
SALVAGE_MARGIN, NEW_PRICE_SHARE, ACCEPTABLE_SHARE = 1.2, 0.85, 0.90


def _hundreds(price: Column) -> Column:
    """Rounded to the nearest hundred, halves to the even hundred."""
    return (F.bround((price / 100).cast("decimal(38,12)"), 0) * 100).cast("double")


def list_prices(pending: DataFrame, progressive: bool = False) -> DataFrame:
    """List, target and lowest acceptable price of every pending sale.

    ``pending``: gpu_uuid, model, health_score, base_price, new_price, salvage_value, under_warranty, urgency_factor,
    demand_factor. The bulk discount counts all pending devices of the model; with ``progressive`` only
    those queued before and the device itself, healthiest first.
    """
    if progressive:
        keyed = pending.withColumn("_order", -F.col("health_score"))
        queued = with_neighbours(keyed.withColumn("_queue", F.struct("_order", "gpu_uuid")), [], key="model", time_col="_queue").drop("_order", "_queue")
        queued = queued.withColumn("pending", F.col("row_index") + 1).drop("row_index")
    else:
        queued = pending.join(pending.groupBy("model").agg(F.count(F.lit(1)).alias("pending")), "model")
    discount = 1 - F.least(F.lit(BULK_LIMIT), F.col("pending") * BULK_STEP)
    health = 0.5 + F.col("health_score") / 100 * 0.7
    premium = F.when(F.col("under_warranty"), WARRANTY_PREMIUM).otherwise(0.0)
    price = F.col("base_price") * health * F.col("urgency_factor") * F.col("demand_factor") * discount + premium
    bounded = F.greatest(F.col("salvage_value") * SALVAGE_MARGIN, F.least(price, F.col("new_price") * NEW_PRICE_SHARE))
    return queued.select("gpu_uuid", "model", "health_score", F.col("pending").cast("long").alias("pending"), discount.alias("bulk_factor"), health.alias("health_factor"),
                         _hundreds(bounded).alias("list_price"), _hundreds(bounded * ACCEPTABLE_SHARE).alias("min_acceptable"))


def decision_ladder(devices: DataFrame) -> DataFrame:
    """``devices`` with ``action``, ``detail`` and ``expected_value`` of the first rung that holds.

    ``devices`` has health_score, lifetime_days, market_value, repair_cost, transaction_cost, repurpose_value,
    decommission_value and salvage_value.
    """
    h, days = F.col("health_score"), F.col("lifetime_days")
    none = F.lit(None).cast("double")
    rungs = [
        ((h > 85) & (days > 365), "KEEP_PRODUCTION", "HIGH_UTILIZATION", none),
        ((h > 70) & (days > 180), "KEEP_PRODUCTION", "MEDIUM_UTILIZATION", none),
        ((h > 50) & (F.col("market_value") > F.col("repair_cost")), "SELL_SECONDARY", None, F.col("market_value") - F.col("transaction_cost")),
        ((h > 40) & (F.col("repurpose_value") > F.col("decommission_value")), "REPURPOSE", "low_criticality_inference", none),
        (F.lit(True), "DECOMMISSION", None, F.col("salvage_value")),
    ]
    pick = None
    for holds, action, detail, worth in rungs:
        rung = F.struct(F.lit(action).alias("action"), F.lit(detail).cast("string").alias("detail"), worth.alias("expected_value"))
        pick = F.when(holds, rung) if pick is None else pick.when(holds, rung)
    return devices.withColumn("_rung", pick).select(*devices.columns, "_rung.action", "_rung.detail", "_rung.expected_value")

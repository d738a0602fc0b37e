"""Registered queries of list prices and the decision ladder (ANA10) and of stored sketches (AGG32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.operators import pricing, sketches
from fleetscope.plans.catalog import finish, register, rnd
from fleetscope.plans.oracle import sql
from fleetscope.plans.q_analytics import HEALTH_CTE, PREDICT_CTE, _health, _predictions
from fleetscope.sources.driver import load_fleet

# Stand-in prices per model: (market base, new).
PRICES = {"NVIDIA H100-SXM5-80GB": (30000.0, 40000.0), "NVIDIA A100-SXM4-80GB": (9000.0, 15000.0), "NVIDIA A100-SXM4-40GB": (6000.0, 10000.0)}

_PRICED = "(VALUES " + ", ".join(f"('{m}', {b}::DOUBLE, {n}::DOUBLE)" for m, (b, n) in PRICES.items()) + ") pr(model, base_price, new_price)"
_PENDING = f"""
WITH p AS (SELECT h.gpu_uuid, a.model, CAST(h.overall_score AS DOUBLE) AS health_score, base_price, new_price, new_price * 0.1 AS salvage_value,
    a.warranty_expiry > DATE '2024-01-31' AS under_warranty, CASE WHEN a.priority = 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS urgency, CASE WHEN a.model LIKE '%H100%' THEN 1.2 ELSE 0.9 END::DOUBLE AS demand
  FROM health h JOIN gpu_assets a ON a.gpu_uuid = h.gpu_uuid JOIN {_PRICED} ON pr.model = a.model),
 q AS (SELECT *, QUEUED AS pending FROM p),
 f AS (SELECT *, 1 - least(0.15::DOUBLE, pending * 0.01::DOUBLE) AS bulk_factor, 0.5 + health_score / 100 * 0.7::DOUBLE AS health_factor FROM q),
 x AS (SELECT *, greatest(salvage_value * 1.2::DOUBLE, least(base_price * health_factor * urgency * demand * bulk_factor + CASE WHEN under_warranty THEN 500.0 ELSE 0.0 END, new_price * 0.85::DOUBLE)) AS price FROM f)
SELECT gpu_uuid, model, health_score, pending, bulk_factor, health_factor, CAST(round_even(CAST(price / 100 AS DECIMAL(38,12)), 0) * 100 AS DOUBLE) AS list_price,
  CAST(round_even(CAST(price * 0.9::DOUBLE / 100 AS DECIMAL(38,12)), 0) * 100 AS DOUBLE) AS min_acceptable FROM x"""


def _pending(spark, sf):
    t, _, h = _health(spark, sf)
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for m, v in PRICES.items() for x in (m, v[i])]), F.col("model"))
    a = t["assets"].where(F.col("model").isin(list(PRICES)))
    d = h.select("gpu_uuid", F.col("overall_score").cast("double").alias("health_score")).join(a, "gpu_uuid")
    return d.select("gpu_uuid", "model", "health_score", pick(0).alias("base_price"), pick(1).alias("new_price"), (pick(1) * 0.1).alias("salvage_value"),
                    (F.col("warranty_expiry") > F.lit("2024-01-31").cast("date")).alias("under_warranty"), F.when(F.col("priority") == 0, 0.9).otherwise(1.0).alias("urgency_factor"),
                    F.when(F.col("model").contains("H100"), 1.2).otherwise(0.9).alias("demand_factor"))


@register("ana10_list_prices", sql(rnd(_PENDING.replace("QUEUED", "count(*) OVER (PARTITION BY model)"), ["health_score", "bulk_factor", "health_factor"]), HEALTH_CTE))
def ana10_list_prices(spark, sf):
    """Every scored device as if it were up for sale, with its model's bulk discount."""
    return finish(pricing.list_prices(_pending(spark, sf)))


@register("ana10_progressive_prices", sql(rnd(_PENDING.replace("QUEUED", "row_number() OVER (PARTITION BY model ORDER BY health_score DESC, gpu_uuid)"), ["health_score", "bulk_factor", "health_factor"]), HEALTH_CTE))
def ana10_progressive_prices(spark, sf):
    return finish(pricing.list_prices(_pending(spark, sf), progressive=True))


@register("ana10_decision_ladder", sql(rnd(f"""
WITH d AS (SELECT p.gpu_uuid, p.health_score, x.estimated_ttf_days * 10 AS lifetime_days, p.base_price * p.health_score / 100 AS market_value, p.new_price * 0.25 AS repair_cost,
    p.base_price * 0.05 AS transaction_cost, p.new_price * 0.12 AS repurpose_value, p.new_price * CASE WHEN a.priority = 0 THEN 0.15 ELSE 0.1 END::DOUBLE AS decommission_value, p.new_price * 0.08 AS salvage_value
  FROM (SELECT h.gpu_uuid, a.model, CAST(h.overall_score AS DOUBLE) AS health_score, base_price, new_price FROM health h JOIN gpu_assets a ON a.gpu_uuid = h.gpu_uuid
        JOIN {_PRICED} ON pr.model = a.model) p JOIN predictions x ON x.gpu_uuid = p.gpu_uuid JOIN gpu_assets a ON a.gpu_uuid = p.gpu_uuid)
SELECT gpu_uuid, health_score, lifetime_days,
  CASE WHEN health_score > 85 AND lifetime_days > 365 THEN 'KEEP_PRODUCTION' WHEN health_score > 70 AND lifetime_days > 180 THEN 'KEEP_PRODUCTION'
    WHEN health_score > 50 AND market_value > repair_cost THEN 'SELL_SECONDARY' WHEN health_score > 40 AND repurpose_value > decommission_value THEN 'REPURPOSE' ELSE 'DECOMMISSION' END AS action,
  CASE WHEN health_score > 85 AND lifetime_days > 365 THEN 'HIGH_UTILIZATION' WHEN health_score > 70 AND lifetime_days > 180 THEN 'MEDIUM_UTILIZATION'
    WHEN health_score > 50 AND market_value > repair_cost THEN NULL WHEN health_score > 40 AND repurpose_value > decommission_value THEN 'low_criticality_inference' END AS detail,
  CASE WHEN health_score > 85 AND lifetime_days > 365 OR health_score > 70 AND lifetime_days > 180 THEN NULL WHEN health_score > 50 AND market_value > repair_cost THEN market_value - transaction_cost
    WHEN health_score > 40 AND repurpose_value > decommission_value THEN NULL ELSE salvage_value END AS expected_value
FROM d""", ["health_score", "expected_value"]), PREDICT_CTE + "," + HEALTH_CTE))
def ana10_decision_ladder(spark, sf):
    t = load_fleet(spark, sf)
    life = _predictions(spark, sf)[2].select("gpu_uuid", (F.col("estimated_ttf_days") * 10).alias("lifetime_days"))
    d = _pending(spark, sf).join(life, "gpu_uuid").join(t["assets"].select("gpu_uuid", "priority"), "gpu_uuid")
    d = d.select("gpu_uuid", "health_score", "lifetime_days", (F.col("base_price") * F.col("health_score") / 100).alias("market_value"), (F.col("new_price") * 0.25).alias("repair_cost"),
                 (F.col("base_price") * 0.05).alias("transaction_cost"), (F.col("new_price") * 0.12).alias("repurpose_value"),
                 (F.col("new_price") * F.when(F.col("priority") == 0, 0.15).otherwise(0.1)).alias("decommission_value"), (F.col("new_price") * 0.08).alias("salvage_value"))
    return finish(pricing.decision_ladder(d).select("gpu_uuid", "health_score", "lifetime_days", "action", "detail", "expected_value"))


WIDTHS = {"1h": "1 hour", "1d": "1 day", "7d": "7 days"}
#: Allowed error of a rank, and of the number of devices.
RANK_ERROR, COUNT_ERROR = 0.02, 0.05


@register("agg32_sketch_windows", sql("""
SELECT w.width, CASE w.width WHEN '1h' THEN time_bucket(INTERVAL '1 hour', time, TIMESTAMP '1970-01-01') WHEN '1d' THEN time_bucket(INTERVAL '1 day', time, TIMESTAMP '1970-01-01')
    ELSE time_bucket(INTERVAL '7 days', time, TIMESTAMP '1970-01-01') END AS time, count(*) AS event_count, count(DISTINCT gpu_uuid) AS exact_gpus,
  true AS p50_ok, true AS p95_ok, true AS p99_ok, true AS gpus_ok, true AS theta_ok
FROM gpu_metrics, (VALUES ('1h'), ('1d'), ('7d')) w(width) GROUP BY 1, 2"""))
def agg32_sketch_windows(spark, sf):
    """p50, p95, p99 and distinct devices of 1 h, 1 d and 7 d from one stored hourly sketch table, held against exact ranks and counts."""
    from fleetscope.session import store
    m = load_fleet(spark, sf)["metrics"]
    stored = store(sketches.sketch_rollup(m, "1 hour"), "sketch-rollup")
    d = sketches.rank_bounds(m, store(sketches.window_estimates(stored, WIDTHS), "sketch-estimates"), WIDTHS)
    one = F.lit(1.0) / F.col("event_count")  # a rank is a whole number of rows
    ok = lambda q, p: ((F.col(f"{q}_lo") - one - RANK_ERROR <= p) & (F.col(f"{q}_hi") + one + RANK_ERROR >= p)).alias(f"{q}_ok")
    near = lambda c, name: (F.abs(F.col(c) - F.col("exact_gpus")) <= F.ceil(F.col("exact_gpus") * COUNT_ERROR)).alias(name)
    return d.select("width", "time", "event_count", "exact_gpus", *[ok(q, p) for q, p in sketches.QUANTILES.items()], near("gpu_count", "gpus_ok"), near("gpu_count_theta", "theta_ok"))

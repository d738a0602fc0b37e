"""Net-present-value lifecycle decisions for the whole fleet (ANA5, JON6, JON8, AGG17, PRJ22).

The 12-month NPV sums are ``aggregate(sequence(0, 11), ...)`` folds, evaluated
per row inside codegen; the residual-value table is a tiny fixed dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions.timewin import as_of_col, window_rows
from fleetscope.operators.health import round_half_up
from fleetscope.operators.latest import latest_per_key

# Secondary-market residual value (USD) by model and health grade,
# and the fallback row for unknown models.
RESIDUAL_BY_MODEL = {
    "NVIDIA A100-SXM4-80GB": {"excellent": 13500, "good": 10500, "fair": 8500, "degraded": 5700,
                              "poor": 3000, "critical": 800},
    "NVIDIA H100-SXM5-80GB": {"excellent": 32000, "good": 28000, "fair": 22000, "degraded": 15000,
                              "poor": 8000, "critical": 2000},
}
RESIDUAL_DEFAULT = {"excellent": 20000, "good": 16000, "fair": 12000, "degraded": 8000, "poor": 4000,
                    "critical": 1000}

# Cost and revenue assumptions.
FAILURE_PROB_CAP = 0.60
POWER_COST_PER_KWH = 0.12
COOLING_PUE = 1.3
POWER_WATTS = 350
MAINTENANCE_COST = 50
REVENUE_PER_GPU_HOUR_FULL = 3.00
REVENUE_PER_GPU_HOUR_INFERENCE = 2.00
ANNUAL_DISCOUNT_RATE = 0.10
HOURS_PER_MONTH = 730
MONTHS = 12
DECISIONS = ["keep", "sell", "repurpose", "decommission"]


def _grade_map(t: dict) -> Column:
    return F.create_map(*[x for g, v in t.items() for x in (F.lit(g), F.lit(float(v)))])


def residual_map(model: Column) -> Column:
    """Grade -> USD map of ``model``, falling back to the default table.

    The lookup table is a literal map in the expression, so it needs no join.
    """
    by_model = F.create_map(*[x for m, t in RESIDUAL_BY_MODEL.items() for x in (F.lit(m), _grade_map(t))])
    return F.coalesce(F.try_element_at(by_model, F.coalesce(model, F.lit(""))), _grade_map(RESIDUAL_DEFAULT))


def npv_keep(h: Column, p90: Column, util: Column, fair: Column) -> Column:
    md = (1.0 + ANNUAL_DISCOUNT_RATE) ** (1.0 / 12.0) - 1.0
    power_cost = (POWER_WATTS / 1000.0) * HOURS_PER_MONTH * POWER_COST_PER_KWH * COOLING_PUE
    net = F.lit(HOURS_PER_MONTH * REVENUE_PER_GPU_HOUR_FULL) * (util / 100.0) - (power_cost + MAINTENANCE_COST)
    risk = F.least(p90, F.lit(FAILURE_PROB_CAP)) * fair
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(MONTHS - 1)), F.lit(0.0),
        lambda acc, m: acc + (net * F.greatest(F.lit(0.2), (h - m * 2) / 100.0) - risk / float(MONTHS))
        * (F.lit(1.0) / F.pow(F.lit(1.0 + md), m)))


def npv_repurpose(h: Column, p90: Column, fair: Column) -> Column:
    md = (1.0 + ANNUAL_DISCOUNT_RATE) ** (1.0 / 12.0) - 1.0
    power_cost = (POWER_WATTS / 1000.0) * HOURS_PER_MONTH * POWER_COST_PER_KWH * COOLING_PUE
    net = HOURS_PER_MONTH * REVENUE_PER_GPU_HOUR_INFERENCE * 0.7 - (power_cost + MAINTENANCE_COST * 0.8)
    risk = F.least(p90, F.lit(FAILURE_PROB_CAP)) * fair
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(MONTHS - 1)), F.lit(0.0),
        lambda acc, m: acc + (F.lit(net) * F.greatest(F.lit(0.3), (h - m) / 100.0) - risk / float(MONTHS))
        * (F.lit(1.0) / F.pow(F.lit(1.0 + md), m)))


def utilization_30d(metrics: DataFrame, as_of: Column, window: str = "30 days") -> DataFrame:
    """avg(sm_active) over ``time >= as_of - window``, 0.5 when NULL or 0 (AGG17)."""
    return (window_rows(metrics, as_of, window, strict=False)
            .groupBy("gpu_uuid").agg(F.avg("sm_active").alias("_util")))


def decision_context(scores: DataFrame, predictions: DataFrame | None, assets: DataFrame,
                     metrics: DataFrame, as_of: Column, util_window: str = "30 days", active: str = "24 hours") -> DataFrame:
    """Latest score + latest prediction + asset model + utilisation per device (JON8).

    The driving set is the devices with a score since ``as_of - active``.
    """
    s = latest_per_key(window_rows(scores, as_of, active, strict=False), "gpu_uuid", "time",
                       ["overall_score", "health_grade"])
    ctx = s.select("gpu_uuid", F.col("overall_score").alias("_h"), F.col("health_grade").alias("_grade"))
    if predictions is not None:
        p = latest_per_key(predictions.where(F.col("time") <= as_of), "gpu_uuid", "time",
                           ["failure_prob_30d", "failure_prob_90d"])
        ctx = ctx.join(p.select("gpu_uuid", F.col("failure_prob_30d").alias("_p30"),
                                F.col("failure_prob_90d").alias("_p90")), "gpu_uuid", "left")
    else:
        ctx = ctx.select("*", F.lit(None).cast("double").alias("_p30"), F.lit(None).cast("double").alias("_p90"))
    ctx = ctx.join(assets.select("gpu_uuid", F.col("model").alias("_model")), "gpu_uuid", "left")
    return ctx.join(utilization_30d(metrics, as_of, util_window), "gpu_uuid", "left")


def economic_decisions(scores: DataFrame, predictions: DataFrame | None, assets: DataFrame,
                       metrics: DataFrame, as_of=None, util_window: str = "30 days", active: str = "24 hours") -> DataFrame:
    """``gpu_economic_decisions`` rows for every device scored since ``as_of - active``."""
    a = as_of_col(metrics, as_of)
    d = decision_context(scores, predictions, assets, metrics, a, util_window, active)
    resid = residual_map(F.col("_model"))
    h = F.coalesce(F.col("_h"), F.lit(70.0))
    grade = F.coalesce(F.col("_grade"), F.lit("fair"))
    p30 = F.coalesce(F.col("_p30"), F.lit(0.1))
    p90 = F.coalesce(F.col("_p90"), F.lit(0.2))
    util = F.when(F.coalesce(F.col("_util"), F.lit(0.0)) != 0, F.col("_util")).otherwise(F.lit(0.5))
    fair = F.coalesce(F.try_element_at(resid, F.lit("fair")), F.lit(12000.0))
    by_grade = F.try_element_at(resid, grade)
    keep = npv_keep(h, p90, util, fair)
    sell = F.coalesce(by_grade, F.coalesce(F.try_element_at(resid, F.lit("fair")), F.lit(10000.0))) * 0.95
    rep = npv_repurpose(h, p90, fair)
    salvage = F.coalesce(by_grade, F.lit(5000.0)) * 0.1
    v = d.select("gpu_uuid", h.alias("health_score"), grade.alias("_g"), p30.alias("failure_prob_30d"),
                 util.alias("utilization"), keep.alias("npv_keep"), sell.alias("npv_sell"),
                 rep.alias("npv_repurpose"), salvage.alias("salvage_value"))
    opts = [F.col("npv_keep"), F.col("npv_sell"), F.col("npv_repurpose"), F.col("salvage_value")]
    top = F.greatest(*opts)
    decision = F.when(opts[0] == top, "keep").when(opts[1] == top, "sell").when(opts[2] == top, "repurpose") \
                .otherwise("decommission")
    ranked = F.sort_array(F.array(*opts), asc=False)
    first, second = ranked[0], ranked[1]
    conf = F.when(first > 0, F.least(F.lit(0.95), F.lit(0.5) + (first - second) / first * 0.5)).otherwise(F.lit(0.5))
    v = v.select("*", decision.alias("decision"), top.alias("_ev"), conf.alias("_conf"))
    return v.select(
        a.alias("time"), "gpu_uuid", "decision",
        round_half_up(F.col("npv_keep"), 2).alias("npv_keep"),
        round_half_up(F.col("npv_sell"), 2).alias("npv_sell"),
        round_half_up(F.col("npv_repurpose"), 2).alias("npv_repurpose"),
        round_half_up(F.col("salvage_value"), 2).alias("salvage_value"),
        round_half_up(F.col("_ev"), 2).alias("expected_value"),
        round_half_up(F.col("_conf"), 2).alias("confidence"),
        rationale(F.col("decision"), F.col("health_score"), F.col("failure_prob_30d"),
                  F.col("npv_keep"), F.col("npv_sell")).alias("rationale"),
        "health_score", "failure_prob_30d", "utilization",
        a.alias("analyzed_at"),
    )


def rationale(decision: Column, h: Column, p: Column, keep: Column, sell: Column) -> Column:
    """Human-readable rationale per decision (PRJ22)."""
    # rounded on the decimal value first, so that ties format alike everywhere
    fixed = lambda c, n: F.format_string(f"%.{n}f", round_half_up(c, n))
    hs, ps = fixed(h, 1), F.concat(fixed(p * 100.0, 1), F.lit("%"))
    ks, ss = fixed(keep, 0), fixed(sell, 0)
    # The four sentences.
    return (F.when(decision == "keep", F.concat(
                F.lit("Recommended to KEEP: Health score "), hs, F.lit("/100 is good, failure risk "), ps,
                F.lit(" is acceptable, NPV of continued operation ($"), ks, F.lit(") exceeds resale value ($"),
                ss, F.lit(").")))
            .when(decision == "sell", F.concat(
                F.lit("Recommended to SELL: Current market value ($"), ss, F.lit(") exceeds future operating value ($"),
                ks, F.lit("). Health score "), hs, F.lit("/100, failure risk "), ps, F.lit(".")))
            .when(decision == "repurpose", F.concat(
                F.lit("Recommended to REPURPOSE: Health score "), hs,
                F.lit("/100 too low for training, but suitable for inference workloads. Failure risk "), ps,
                F.lit(".")))
            .otherwise(F.concat(
                F.lit("Recommended to DECOMMISSION: Health score "), hs, F.lit("/100 critical, failure risk "), ps,
                F.lit(" too high. Salvage for parts."))))

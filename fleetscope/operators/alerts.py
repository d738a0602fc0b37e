"""Alert queries over scores and anomalies (ANA6, TOP4, STR10 batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.timewin import since
from fleetscope.operators.latest import latest_per_key

# Alert tiers of the design document — (level, probability column,
# probability above, confidence above or None, action), checked in this order.
ALERT_TIERS = [
    ("CRITICAL", "failure_prob_7d", 0.80, 0.85, "Remove from production immediately"),
    ("HIGH", "failure_prob_30d", 0.70, 0.80, "Schedule replacement within 7 days"),
    ("MEDIUM", "failure_prob_90d", 0.50, 0.75, "Schedule replacement within 30 days"),
    ("LOW", "failure_prob_90d", 0.30, None, "Add to watchlist, monitor trends"),
]


def low_health(scores: DataFrame, assets: DataFrame, as_of: Column, threshold: float = 70.0) -> DataFrame:
    """Latest score per device below ``threshold`` with model and host, worst first (the
    API's alert list: ANA6, JON2, TOP3)."""
    last = latest_per_key(scores.where(F.col("time") <= as_of), "gpu_uuid", "time",
                          ["overall_score", "health_grade", "degradation_factors"])
    low = last.where(F.col("overall_score") < threshold)
    return (low.join(assets.select("gpu_uuid", "model", "hostname"), "gpu_uuid", "left")
               .select("gpu_uuid", "model", "hostname", "overall_score", "health_grade", "degradation_factors",
                       F.col("time").alias("scored_at"))
               .orderBy("overall_score", "gpu_uuid"))


def recent_critical_health(scores: DataFrame, as_of: Column, window: str = "30 minutes",
                           threshold: float = 50.0, top: int = 10) -> DataFrame:
    """Scores below ``threshold`` since ``as_of - window`` (the bound included), newest ``top`` (TOP4)."""
    return (scores.where(since("time", as_of, window, strict=False) & (F.col("overall_score") < threshold))
                  .orderBy(F.col("time").desc(), F.col("gpu_uuid")).limit(top))


def alert_level(confidence: Column | None = None) -> Column:
    """Struct (level, action) of the first matching tier, NULL below every tier ([D])."""
    confidence = confidence if confidence is not None else F.col("confidence")
    expr = None
    for level, col, p, c, action in ALERT_TIERS:
        cond = F.col(col) > p
        if c is not None:
            cond = cond & (confidence > c)
        val = F.struct(F.lit(level).alias("level"), F.lit(action).alias("action"))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def alert_events(predictions: DataFrame) -> DataFrame:
    """Typed alert records (STR10): one per prediction that reaches a tier."""
    return (predictions.withColumn("_a", alert_level()).where(F.col("_a").isNotNull())
            .select(F.col("time").alias("alert_time"), "gpu_uuid", F.col("_a.level").alias("level"),
                    F.col("_a.action").alias("action"), "failure_prob_7d", "failure_prob_30d", "failure_prob_90d",
                    "predicted_failure_type", "estimated_ttf_days", "confidence"))

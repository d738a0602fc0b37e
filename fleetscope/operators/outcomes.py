"""What became of alerts, failures and decisions (ANA11), by first-match intervals.

An alert is open from its time until the horizon ends or a failure comes, whichever is first. A
failure is predicted if an alert was open when it came; its lead time counts from the earliest
one still open. A decision waits for its execution until the device's next decision; the first
outcome executed in that interval is the decision's, so an outcome belongs to one decision.

Every match is a probe into the other side's time order (``operators/asof.py``) at the start
of the interval, and a comparison with its end. There is no join on the device alone, so the
number of alerts, failures or outcomes of a device does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.asof import asof_join
from fleetscope.operators.scan import with_neighbours

DAY_SECONDS = 86_400.0


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / (DAY_SECONDS * 1e6)


def _days(n: float) -> Column:
    return F.make_dt_interval(days=F.lit(int(n)))


def alert_outcomes(alerts: DataFrame, failures: DataFrame, horizon_days: int = 30, key: str = "gpu_uuid") -> DataFrame:
    """Each alert with ``hit`` (a failure came within the horizon), that failure's time and ``lead_days``."""
    met = asof_join(alerts, failures.select(key, "time"), key=key)
    came = F.when(F.col("next_event.time") <= F.col("time") + _days(horizon_days), F.col("next_event.time"))
    return met.select(*alerts.columns, came.isNotNull().alias("hit"), came.alias("failure_time"), days_between(F.col("time"), came).alias("lead_days"))


def failure_outcomes(failures: DataFrame, alerts: DataFrame, horizon_days: int = 30, key: str = "gpu_uuid") -> DataFrame:
    """Each failure with ``predicted``, the time of the earliest alert still open and ``lead_days``."""
    f = with_neighbours(failures, ["time"], back=1, key=key).drop("row_index")
    # alerts up to the failure before are closed by it, older ones than the horizon have run out
    opens = F.greatest(F.col("time") - _days(horizon_days), F.timestamp_micros(F.unix_micros("time_m1") + 1))
    met = asof_join(f.withColumn("_opens", opens), alerts.select(key, "time"), time="_opens", key=key, same_time_is_last=False)
    warned = F.when(F.col("next_event.time") < F.col("time"), F.col("next_event.time"))
    return met.select(*failures.columns, warned.isNotNull().alias("predicted"), warned.alias("alert_time"), days_between(warned, F.col("time")).alias("lead_days"))


def monthly_outcomes(failures: DataFrame, alerts: DataFrame, by: list[str] | None = None, false_alarm_cost: float = 250.0, useful_days: float = 1.0) -> DataFrame:
    """Hits, misses, lead days and cost per month (and ``by``) of ``failure_outcomes`` and ``alert_outcomes``.

    A missed failure costs its ``financial_impact``, a predicted one saves it; one predicted
    with less than ``useful_days`` of lead counts as ``late``. An alert without a failure
    costs ``false_alarm_cost``.
    """
    keys = ["month", *(by or [])]
    month = F.date_trunc("month", "time").alias("month")
    n = lambda c: F.count_if(c)
    impact = lambda c: F.coalesce(F.sum(F.when(c, F.col("financial_impact"))), F.lit(0.0))
    hit = F.col("predicted")
    of_failures = failures.select("*", month).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("failures"), n(hit).alias("predicted"), n(~hit).alias("missed"), n(hit & (F.col("lead_days") < useful_days)).alias("late"),
        F.avg("lead_days").alias("mean_lead_days"), impact(hit).alias("avoided_cost"), impact(~hit).alias("missed_cost"))
    of_alerts = alerts.select("*", month).groupBy(*keys).agg(F.count(F.lit(1)).alias("alerts"), n(~F.col("hit")).alias("false_alarms"))
    on = [F.col(f"f.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    met = of_failures.alias("f").join(of_alerts.alias("a"), on, "full")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    money = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    wasted = F.coalesce(F.col("false_alarms"), F.lit(0)) * F.lit(false_alarm_cost)
    return met.select(*[F.coalesce(F.col(f"f.{k}"), F.col(f"a.{k}")).alias(k) for k in keys], count("failures"), count("predicted"), count("missed"), count("late"),
                      "mean_lead_days", count("alerts"), count("false_alarms"), money("avoided_cost").alias("avoided_cost"), money("missed_cost").alias("missed_cost"),
                      wasted.alias("false_alarm_cost"), (money("avoided_cost") - money("missed_cost") - wasted).alias("net_value"))


def decision_outcomes(decisions: DataFrame, outcomes: DataFrame, key: str = "gpu_uuid") -> DataFrame:
    """Each decision (time, action, expected_value, ...) with the first outcome (time, action, value) executed before the next decision."""
    d = with_neighbours(decisions, ["time"], ahead=1, key=key).drop("row_index")
    met = asof_join(d, outcomes.select(key, "time", "action", "value"), key=key, same_time_is_last=False)
    e = F.col("next_event")
    done = F.when(F.col("time_p1").isNull() | (e["time"] < F.col("time_p1")), e)
    return met.withColumn("_done", done).select(
        *decisions.columns, F.col("_done.time").isNotNull().alias("decision_executed"), F.col("_done.time").alias("execution_date"),
        F.col("_done.action").alias("executed_action"), (F.col("_done.action") == F.col("action")).alias("as_decided"),
        days_between(F.col("time"), F.col("_done.time")).alias("delay_days"), F.col("_done.value").alias("outcome_value"),
        (F.col("_done.value") - F.col("expected_value")).alias("value_gap"))


def decision_report(tracked: DataFrame) -> DataFrame:
    """Decisions by month and action: how many were executed, as decided, how late and at what value."""
    return tracked.groupBy(F.date_trunc("month", "time").alias("month"), "action").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if("decision_executed").alias("executed"), F.count_if("as_decided").alias("as_decided"),
        F.avg("delay_days").alias("mean_delay_days"), F.sum(F.when(F.col("decision_executed"), F.col("expected_value"))).alias("expected_value"),
        F.sum("outcome_value").alias("outcome_value"), F.avg("value_gap").alias("mean_value_gap"))

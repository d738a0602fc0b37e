"""Registered queries of failure labels and outcome tracking (ANA4 labels, ANA11).

Stand-ins: samples with an uncorrectable error are the recorded failures, samples whose rule
score passes 0.5 are alerts, a device's daily mean decides its action, and the orders are
what was executed in the end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions.columns import age_months, json_text_field
from fleetscope.functions.timewin import as_of_col
from fleetscope.operators import outcomes, predict, tables, training
from fleetscope.operators.asof import version_at
from fleetscope.operators.rollups import bucket
from fleetscope.plans.catalog import finish, register, rnd
from fleetscope.plans.oracle import sql
from fleetscope.sources.driver import load_fleet, read_table

HORIZON = 7

_CTE = """
failures AS (SELECT gpu_uuid, time, CASE WHEN throttle_reasons > 0 THEN 'thermal' WHEN ecc_sbe_volatile > 100 THEN 'memory' ELSE 'other' END AS failure_type,
    10.0::DOUBLE * power_usage AS financial_impact
  FROM gpu_metrics WHERE ecc_dbe_volatile > 0),
alerts AS (SELECT gpu_uuid, time, CASE WHEN throttle_reasons > 0 THEN 'thermal' WHEN ecc_sbe_volatile > 100 THEN 'memory' ELSE 'other' END AS failure_type
  FROM gpu_metrics WHERE (CASE WHEN gpu_temp > 85 THEN 0.4 WHEN gpu_temp > 80 THEN 0.2 WHEN gpu_temp > 75 THEN 0.1 ELSE 0.0 END
    + CASE WHEN throttle_reasons > 0 THEN 0.3 ELSE 0.0 END + CASE WHEN ecc_sbe_volatile > 100 THEN 0.2 ELSE 0.0 END) >= 0.5),
ordered_failures AS (SELECT *, lag(time) OVER (PARTITION BY gpu_uuid ORDER BY time) AS before FROM failures),
failure_outcomes AS (
  SELECT f.gpu_uuid, f.time, any_value(f.failure_type) AS failure_type, any_value(f.financial_impact) AS financial_impact, min(a.time) AS alert_time
  FROM ordered_failures f LEFT JOIN alerts a ON a.gpu_uuid = f.gpu_uuid AND a.time < f.time AND a.time >= f.time - INTERVAL 7 DAY
    AND (f.before IS NULL OR a.time > f.before)
  GROUP BY 1, 2),
alert_outcomes AS (
  SELECT a.gpu_uuid, a.time, any_value(a.failure_type) AS failure_type, min(f.time) AS failure_time
  FROM alerts a LEFT JOIN failures f ON f.gpu_uuid = a.gpu_uuid AND f.time > a.time AND f.time <= a.time + INTERVAL 7 DAY GROUP BY 1, 2),
decisions AS (SELECT gpu_uuid, time_bucket(INTERVAL '1 day', time) AS time, CASE WHEN avg(gpu_temp) > 80 THEN 'decommission' WHEN avg(gpu_temp) > 72 THEN 'sell'
    WHEN avg(gpu_temp) > 65 THEN 'repurpose' ELSE 'keep' END AS action, 10.0::DOUBLE * avg(power_usage) AS expected_value FROM gpu_metrics GROUP BY 1, 2),
executed AS (SELECT concat('GPU-', lpad(CAST(o_custkey // 10 AS VARCHAR), 6, '0')) AS gpu_uuid,
    TIMESTAMP '2024-01-01' + to_seconds(CAST(o_orderkey * 7919 % 2592000 AS INTEGER)) + to_microseconds(o_orderkey % 1000000) AS time,
    CASE o_orderstatus WHEN 'F' THEN 'sell' WHEN 'O' THEN 'repurpose' ELSE 'decommission' END AS action, o_totalprice / 100 AS value FROM orders),
ordered_decisions AS (SELECT *, lead(time) OVER (PARTITION BY gpu_uuid ORDER BY time) AS until FROM decisions),
tracked AS (SELECT d.gpu_uuid, d.time, any_value(d.action) AS action, any_value(d.expected_value) AS expected_value, min(e.time) AS execution_date,
    arg_min(e.action, e.time) AS executed_action, arg_min(e.value, e.time) AS outcome_value
  FROM ordered_decisions d LEFT JOIN executed e ON e.gpu_uuid = d.gpu_uuid AND e.time >= d.time AND (d.until IS NULL OR e.time < d.until) GROUP BY 1, 2)"""


def _kind():
    return F.when(F.col("throttle_reasons") > 0, "thermal").when(F.col("ecc_sbe_volatile") > 100, "memory").otherwise("other").alias("failure_type")


def _failures(m):
    return m.where("ecc_dbe_volatile > 0").select("gpu_uuid", "time", _kind(), (F.lit(10.0) * F.col("power_usage")).alias("financial_impact"))


def _alerts(m):
    throttles = F.when(F.col("throttle_reasons") > 0, 21).otherwise(0)
    p = predict.heuristic_p30(F.col("gpu_temp"), throttles, F.lit(0), F.col("ecc_sbe_volatile"), F.lit(0))
    return m.where(p >= 0.5).select("gpu_uuid", "time", _kind())


def _decisions(m):
    daily = m.groupBy("gpu_uuid", F.window("time", "1 day").start.alias("time")).agg(F.avg("gpu_temp").alias("t"), F.avg("power_usage").alias("p"))
    action = F.when(F.col("t") > 80, "decommission").when(F.col("t") > 72, "sell").when(F.col("t") > 65, "repurpose").otherwise("keep")
    return daily.select("gpu_uuid", "time", action.alias("action"), (F.lit(10.0) * F.col("p")).alias("expected_value"))


def _executed(orders):
    key = F.col("o_orderkey")
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    when = F.timestamp_micros(start + (key * 7919 % 2592000) * 1_000_000 + key % 1_000_000)
    action = F.when(F.col("o_orderstatus") == "F", "sell").when(F.col("o_orderstatus") == "O", "repurpose").otherwise("decommission")
    return orders.select(F.concat(F.lit("GPU-"), F.lpad(F.expr("o_custkey div 10").cast("string"), 6, "0")).alias("gpu_uuid"), when.alias("time"), action.alias("action"),
                         (F.col("o_totalprice") / 100).alias("value"))


def _m(spark, sf):
    return load_fleet(spark, sf)["metrics"]


@register("ana04_failure_labels", sql(rnd("""
SELECT m.gpu_uuid, m.time, any_value(m.gpu_temp) AS gpu_temp, CAST(coalesce(min(n.time) <= m.time + INTERVAL 7 DAY, false) AS INTEGER) AS label,
  (epoch_us(min(n.time)) - epoch_us(m.time)) / 8.64e10 AS lead_days, arg_min(n.failure_type, n.time) AS next_failure_type,
  (epoch_us(m.time) - epoch_us(any_value(l.last))) / 8.64e10 AS days_since_failure
FROM gpu_metrics m LEFT JOIN failures n ON n.gpu_uuid = m.gpu_uuid AND n.time > m.time
LEFT JOIN (SELECT m.gpu_uuid, m.time, max(f.time) AS last FROM gpu_metrics m JOIN failures f ON f.gpu_uuid = m.gpu_uuid AND f.time <= m.time GROUP BY 1, 2) l
  ON l.gpu_uuid = m.gpu_uuid AND l.time = m.time
GROUP BY 1, 2""", ["gpu_temp", "lead_days", "days_since_failure"]), _CTE))
def ana04_failure_labels(spark, sf):
    """Every sample with its failure label, lead time and time since the last failure."""
    m = _m(spark, sf)
    return finish(predict.labels_within_horizon(m.select("gpu_uuid", "time", "gpu_temp"), _failures(m).withColumnRenamed("time", "failure_date"), HORIZON))


@register("ana11_failure_outcomes", sql(rnd("""
SELECT gpu_uuid, time, failure_type, financial_impact, alert_time IS NOT NULL AS predicted, alert_time,
  (epoch_us(time) - epoch_us(alert_time)) / 8.64e10 AS lead_days FROM failure_outcomes""", ["financial_impact", "lead_days"]), _CTE))
def ana11_failure_outcomes(spark, sf):
    m = _m(spark, sf)
    return finish(outcomes.failure_outcomes(_failures(m), _alerts(m), HORIZON))


@register("ana11_alert_outcomes", sql(rnd("""
SELECT gpu_uuid, time, failure_type, failure_time IS NOT NULL AS hit, failure_time,
  (epoch_us(failure_time) - epoch_us(time)) / 8.64e10 AS lead_days FROM alert_outcomes""", ["lead_days"]), _CTE))
def ana11_alert_outcomes(spark, sf):
    m = _m(spark, sf)
    return finish(outcomes.alert_outcomes(_alerts(m), _failures(m), HORIZON))


@register("ana11_monthly_cost", sql(rnd("""
WITH f AS (SELECT date_trunc('month', time) AS month, failure_type, model, count(*) AS failures, count(alert_time) AS predicted, count(*) - count(alert_time) AS missed,
    count_if(epoch_us(time) - epoch_us(alert_time) < 8.64e10) AS late, avg((epoch_us(time) - epoch_us(alert_time)) / 8.64e10) AS lead,
    coalesce(sum(financial_impact) FILTER (alert_time IS NOT NULL), 0) AS avoided, coalesce(sum(financial_impact) FILTER (alert_time IS NULL), 0) AS lost
  FROM failure_outcomes LEFT JOIN gpu_assets USING (gpu_uuid) GROUP BY 1, 2, 3),
 a AS (SELECT date_trunc('month', time) AS month, failure_type, model, count(*) AS alerts, count(*) - count(failure_time) AS false_alarms
  FROM alert_outcomes LEFT JOIN gpu_assets USING (gpu_uuid) GROUP BY 1, 2, 3),
 k AS (SELECT month, failure_type, model FROM f UNION SELECT month, failure_type, model FROM a)
SELECT k.month, k.failure_type, k.model, coalesce(failures, 0) AS failures, coalesce(predicted, 0) AS predicted, coalesce(missed, 0) AS missed,
  CAST(coalesce(late, 0) AS BIGINT) AS late, lead AS mean_lead_days, coalesce(alerts, 0) AS alerts, coalesce(false_alarms, 0) AS false_alarms,
  coalesce(avoided, 0) AS avoided_cost, coalesce(lost, 0) AS missed_cost, coalesce(false_alarms, 0) * 250.0::DOUBLE AS false_alarm_cost,
  coalesce(avoided, 0) - coalesce(lost, 0) - coalesce(false_alarms, 0) * 250.0::DOUBLE AS net_value
FROM k LEFT JOIN f ON f.month = k.month AND f.failure_type = k.failure_type AND f.model IS NOT DISTINCT FROM k.model
  LEFT JOIN a ON a.month = k.month AND a.failure_type = k.failure_type AND a.model IS NOT DISTINCT FROM k.model""",
                                            ["mean_lead_days", "avoided_cost", "missed_cost", "false_alarm_cost", "net_value"]), _CTE))
def ana11_monthly_cost(spark, sf):
    t = load_fleet(spark, sf)
    m, models = t["metrics"], t["assets"].select("gpu_uuid", "model")
    failed, alerted = _failures(m), _alerts(m)
    with_model = lambda d: d.join(models, "gpu_uuid", "left")
    return finish(outcomes.monthly_outcomes(with_model(outcomes.failure_outcomes(failed, alerted, HORIZON)), with_model(outcomes.alert_outcomes(alerted, failed, HORIZON)),
                                            ["failure_type", "model"]))


@register("ana11_decision_outcomes", sql(rnd("""
SELECT gpu_uuid, time, action, expected_value, execution_date IS NOT NULL AS decision_executed, execution_date, executed_action,
  executed_action = action AS as_decided, (epoch_us(execution_date) - epoch_us(time)) / 8.64e10 AS delay_days, outcome_value, outcome_value - expected_value AS value_gap
FROM tracked""", ["expected_value", "delay_days", "outcome_value", "value_gap"]), _CTE))
def ana11_decision_outcomes(spark, sf):
    return finish(outcomes.decision_outcomes(_decisions(_m(spark, sf)), _executed(read_table(spark, sf, "orders"))))


@register("ana11_decision_report", sql(rnd("""
SELECT date_trunc('month', time) AS month, action, count(*) AS decisions, count(execution_date) AS executed,
  CAST(count_if(executed_action = action) AS BIGINT) AS as_decided, avg((epoch_us(execution_date) - epoch_us(time)) / 8.64e10) AS mean_delay_days,
  sum(expected_value) FILTER (execution_date IS NOT NULL) AS expected_value, sum(outcome_value) AS outcome_value, avg(outcome_value - expected_value) AS mean_value_gap
FROM tracked GROUP BY 1, 2""", ["mean_delay_days", "expected_value", "outcome_value", "mean_value_gap"]), _CTE))
def ana11_decision_report(spark, sf):
    return finish(outcomes.decision_report(outcomes.decision_outcomes(_decisions(_m(spark, sf)), _executed(read_table(spark, sf, "orders")))))


_TYPED = """typed AS (SELECT CASE WHEN throttle_reasons > 0 THEN 'thermal' WHEN ecc_sbe_volatile > 100 THEN 'memory' ELSE 'other' END AS failure_type,
    CASE WHEN throttle_reasons > 0 OR gpu_temp > 85 THEN 'thermal' WHEN ecc_sbe_volatile > 50 THEN 'memory' ELSE 'other' END AS predicted_type FROM gpu_metrics)"""


def _typed(m):
    throttles = F.when(F.col("throttle_reasons") > 0, 21).otherwise(0)
    return m.select(_kind(), predict.failure_type(F.col("gpu_temp"), throttles, F.lit(0), F.col("ecc_sbe_volatile"), F.lit(0)).alias("predicted_type"))


@register("ana04_type_confusion", sql("SELECT failure_type AS actual, predicted_type AS predicted, count(*) AS n FROM typed GROUP BY 1, 2", _TYPED))
def ana04_type_confusion(spark, sf):
    """Recorded failure type of every sample against the rule's type."""
    return training.confusion_matrix(_typed(_m(spark, sf)))


@register("ana04_type_report", sql(rnd("""
WITH c AS (SELECT failure_type FROM typed UNION SELECT predicted_type FROM typed),
 n AS (SELECT c.failure_type, count_if(t.failure_type = c.failure_type AND t.predicted_type = c.failure_type) AS hit,
   count_if(t.predicted_type = c.failure_type) AS said, count_if(t.failure_type = c.failure_type) AS support FROM c, typed t GROUP BY 1)
SELECT failure_type, CASE WHEN said > 0 THEN hit / said END AS precision, CASE WHEN support > 0 THEN hit / support END AS recall, 2.0 * hit / (said + support) AS f1,
  CAST(support AS BIGINT) AS support FROM n""", ["precision", "recall", "f1"]), _TYPED))
def ana04_type_report(spark, sf):
    return finish(training.type_report(_typed(_m(spark, sf))))


@register("ana04_training_set", sql("""
WITH r AS (SELECT m.gpu_uuid, m.time, CAST(EXISTS (SELECT 1 FROM failures f WHERE f.gpu_uuid = m.gpu_uuid AND f.time > m.time AND f.time <= m.time + INTERVAL 1 DAY) AS INTEGER) AS label
  FROM gpu_metrics m)
SELECT label, CASE WHEN label = 1 THEN count(*) ELSE least(count(*), 3 * (SELECT count(*) FROM r WHERE label = 1)) END AS n FROM r GROUP BY label""", _CTE))
def ana04_training_set(spark, sf):
    """Class sizes of the balanced training set: every sample within a day of a failure, three controls for each."""
    m = _m(spark, sf)
    rows = predict.labels_within_horizon(m.select("gpu_uuid", "time"), _failures(m).withColumnRenamed("time", "failure_date"), 1).select("gpu_uuid", "time", "label")
    return training.balanced_sample(rows, 3).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("jon12_versioned_dimension", sql("""
WITH v AS (SELECT gpu_uuid, TIMESTAMP '2000-01-01' AS valid_from, CASE WHEN priority = 1 THEN TIMESTAMP '2024-01-10' ELSE TIMESTAMP '2024-01-15' END AS valid_to, rack_id FROM gpu_assets
  UNION ALL SELECT gpu_uuid, TIMESTAMP '2024-01-15', NULL, concat('moved-', rack_id) FROM gpu_assets WHERE priority < 3)
SELECT m.gpu_uuid, m.time, v.rack_id FROM gpu_metrics m LEFT JOIN v ON v.gpu_uuid = m.gpu_uuid AND v.valid_from <= m.time AND (v.valid_to IS NULL OR m.time < v.valid_to)"""))
def jon12_versioned_dimension(spark, sf):
    """Every sample with the rack its device stood in at the time; some devices moved, some have no valid version for a while."""
    t = load_fleet(spark, sf)
    at = lambda text: F.lit(text).cast("timestamp")
    a = t["assets"]
    first = a.select("gpu_uuid", at("2000-01-01").alias("valid_from"), F.when(F.col("priority") == 1, at("2024-01-10")).otherwise(at("2024-01-15")).alias("valid_to"), "rack_id")
    moved = a.where("priority < 3").select("gpu_uuid", at("2024-01-15").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.concat(F.lit("moved-"), "rack_id").alias("rack_id"))
    return version_at(t["metrics"].select("gpu_uuid", "time"), first.unionByName(moved), ["rack_id"])


@register("snk10_invalidated_buckets", sql(rnd("""
WITH late AS (SELECT DISTINCT time_bucket(INTERVAL '5 minutes', time) AS time FROM gpu_metrics WHERE collection_latency_ms = 49)
SELECT time_bucket(INTERVAL '5 minutes', m.time) AS time, m.gpu_uuid, avg(gpu_temp) AS gpu_temp_avg, max(gpu_temp) AS gpu_temp_max, count(*) AS sample_count
FROM gpu_metrics m JOIN late ON late.time = time_bucket(INTERVAL '5 minutes', m.time) GROUP BY 1, 2""", ["gpu_temp_avg", "gpu_temp_max"])))
def snk10_invalidated_buckets(spark, sf):
    """The 5-minute rows that are recomputed when the slowest samples arrive late."""
    m = _m(spark, sf)
    late = m.where("collection_latency_ms = 49").select(bucket("time", "5 minutes").alias("time"))
    return finish(tables.invalid_frame(m, late, "5min").select("time", "gpu_uuid", "gpu_temp_avg", "gpu_temp_max", "sample_count"))


@register("prj12_asset_age_months", sql("""
SELECT a.gpu_uuid, a.model, json_extract_string(a.tags, '$.profile') AS profile, d.datacenter, d.rack_id,
  CAST((year(as_of) - year(a.deployment_date)) * 12 + month(as_of) - month(a.deployment_date) - CASE WHEN day(as_of) < day(a.deployment_date) THEN 1 ELSE 0 END AS INTEGER) AS age_months
FROM gpu_assets a JOIN gpu_datacenter_mapping d ON a.gpu_uuid = d.gpu_uuid, as_of"""))
def prj12_asset_age_months(spark, sf):
    """Every asset with its place and its age in whole months at ``as_of``."""
    t = load_fleet(spark, sf)
    a = t["assets"].withColumn("as_of", as_of_col(t["metrics"]))
    d = a.select("gpu_uuid", "model", json_text_field("tags", "profile").alias("profile"), age_months("as_of", "deployment_date").alias("age_months"))
    return d.join(t["mapping"].select("gpu_uuid", "datacenter", "rack_id"), "gpu_uuid").select("gpu_uuid", "model", "profile", "datacenter", "rack_id", "age_months")

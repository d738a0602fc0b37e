"""Registered market and forecast queries (SRC6, ANA8, ANA9, AGG13, AGG14, ANA7, SET2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions.timewin import as_of_col
from fleetscope.operators import forecast, market
from fleetscope.plans.catalog import DRIVER_PARAMS as P
from fleetscope.plans.catalog import finish, register, rnd
from fleetscope.plans.oracle import sql
from fleetscope.plans.q_analytics import ECON_CTES, HEALTH_CTE, _decisions, _health, _score_history
from fleetscope.session import store
from fleetscope.sources.driver import load_fleet, page_model, price_texts_from_parts, read_table

# Sanity bounds applied to the part-brand "models" of the stand-in pages.
STANDIN_BOUNDS = (5000.0, 25000.0)


def _pages(spark, sf):
    return price_texts_from_parts(read_table(spark, sf, "part"))


def _fallback(spark, sf):
    """Fallback rows per (brand, condition), derived from the part list."""
    part = read_table(spark, sf, "part")
    g = part.groupBy(page_model().alias("model")).agg(
        (F.min("p_retailprice") * 8.0).alias("low"), (F.max("p_retailprice") * 8.0).alias("high"),
        (F.avg("p_retailprice") * 8.0).alias("mid"), (F.avg("p_retailprice") * 20.0).alias("original_cost_usd"))
    return g.select("model", F.explode(F.array(F.lit("used_good"), F.lit("used_fair"))).alias("condition"),
                    "low", "high", "mid", "original_cost_usd")


PAGES_CTE = r"""
pg AS (
  SELECT p_partkey AS page_id, {MODEL} AS model,
    CASE WHEN p_partkey % 2 = 0 THEN 'used_good' ELSE 'used_fair' END AS condition,
    CAST(floor(p_retailprice * 10.0) AS BIGINT) AS lo, CAST(floor(p_retailprice * 14.0) AS BIGINT) AS hi,
    TIMESTAMP '2024-01-31 00:00:00' + to_minutes(CAST(p_partkey AS INTEGER)) AS fetched_at,
    p_retailprice AS original_cost_usd, p_name, p_partkey
  FROM part),
pt AS (
  SELECT *, CASE WHEN p_partkey % 7 = 6 THEN p_name || ' Listed at $' || format('{:,}', lo) || ' today.'
            WHEN p_partkey % 11 = 5 THEN p_name || ' Secondary market $' || format('{:,}', hi) || '-$' || format('{:,}', hi + lo)
              || ' Used (good) $' || format('{:,}', lo) || '-$' || format('{:,}', hi)
            ELSE p_name || ' Used market Secondary range: $' || format('{:,}', lo)
                 || CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '–' ELSE '—' END
                 || '$' || format('{:,}', hi) || ' per unit' END AS txt
  FROM pg),
px AS (
  SELECT *, nullif(regexp_extract(txt, '(?s)[Ss]econdary.*?(\$[\d,]+\s*[-–—]\s*\$[\d,]+)', 1), '') AS sec,
    nullif(regexp_extract(txt, '(?s)[Uu]sed.*?(\$[\d,]+\s*[-–—]\s*\$[\d,]+)', 1), '') AS usd
  FROM pt),
ps AS (  -- the rule of each model: sections in order, then any price, or nothing
  SELECT *, CASE model WHEN 'NVIDIA A100-SXM4-80GB' THEN coalesce(usd, txt)
                       WHEN 'NVIDIA H100-SXM5-80GB' THEN coalesce(sec, usd, '')
                       ELSE coalesce(sec, usd, txt) END AS src FROM px),
pr AS (SELECT *, regexp_extract(src, '\$[\d,]+\s*[-–—]\s*\$[\d,]+', 0) AS rng FROM ps),
prices AS (
  SELECT page_id, model, condition, fetched_at, original_cost_usd,
    CASE WHEN rng <> '' THEN TRY_CAST(regexp_replace(regexp_extract(rng, '(\$[\d,]+)', 1), '[$,]', '', 'g') AS DOUBLE)
         ELSE TRY_CAST(regexp_replace(regexp_extract(src, '\$[\d,]+', 0), '[$,]', '', 'g') AS DOUBLE) END AS low,
    CASE WHEN rng <> '' THEN TRY_CAST(regexp_replace(regexp_extract(rng, '[-–—]\s*(\$[\d,]+)', 1), '[$,]', '', 'g') AS DOUBLE)
         ELSE TRY_CAST(regexp_replace(regexp_extract(src, '\$[\d,]+', 0), '[$,]', '', 'g') AS DOUBLE) END AS high
  FROM pr),
pm AS (SELECT *, CASE WHEN low IS NULL THEN NULL WHEN low = high THEN low
                      ELSE CAST(round(CAST((low + high) / 2.0 AS DECIMAL(38,12)), 2) AS DOUBLE) END AS mid FROM prices),
fb AS (
  SELECT {MODEL} AS model, c.condition, min(p_retailprice) * 8.0 AS f_low, max(p_retailprice) * 8.0 AS f_high,
    avg(p_retailprice) * 8.0 AS f_mid, avg(p_retailprice) * 20.0 AS f_orig
  FROM part, (VALUES ('used_good'), ('used_fair')) c(condition) GROUP BY 1, 2),
mp AS (
  SELECT pm.fetched_at, pm.model, pm.condition,
    (pm.low IS NOT NULL AND least(pm.low, pm.high) >= {LOW} AND greatest(pm.low, pm.high) <= {HIGH}) AS ok,
    pm.low, pm.high, pm.mid, pm.original_cost_usd, fb.f_low, fb.f_high, fb.f_mid, fb.f_orig
  FROM pm LEFT JOIN fb ON pm.model = fb.model AND pm.condition = fb.condition),
market_prices AS (
  SELECT fetched_at, model, condition,
    CASE WHEN ok THEN low ELSE f_low END AS price_low_usd, CASE WHEN ok THEN high ELSE f_high END AS price_high_usd,
    CASE WHEN ok THEN mid ELSE f_mid END AS price_mid_usd, coalesce(f_orig, original_cost_usd) AS original_cost_usd,
    CASE WHEN ok THEN 'web_scrape' WHEN f_low IS NOT NULL THEN 'fallback' END AS source
  FROM mp WHERE ok OR f_low IS NOT NULL)"""
PAGES_CTE = (PAGES_CTE.replace("{MODEL}", """CASE WHEN p_partkey % 5 = 1 THEN 'NVIDIA A100-SXM4-80GB'
    WHEN p_partkey % 5 = 3 THEN 'NVIDIA H100-SXM5-80GB' ELSE p_brand END""")
             .replace("{LOW}", "CASE pm.model WHEN 'NVIDIA A100-SXM4-80GB' THEN 1000.0 WHEN 'NVIDIA H100-SXM5-80GB' THEN 5000.0 ELSE 5000.0 END")
             .replace("{HIGH}", "CASE pm.model WHEN 'NVIDIA A100-SXM4-80GB' THEN 50000.0 WHEN 'NVIDIA H100-SXM5-80GB' THEN 100000.0 ELSE 25000.0 END"))


@register("src06_price_extraction", sql("SELECT page_id, model, condition, low, high, mid FROM pm", PAGES_CTE))
def src06_price_extraction(spark, sf):
    x = market.extract_prices(_pages(spark, sf))
    return x.select("page_id", "model", "condition", F.col("price.low").alias("low"),
                    F.col("price.high").alias("high"), F.col("price.mid").alias("mid"))


def _market_prices(spark, sf):
    x = market.extract_prices(_pages(spark, sf))
    return market.price_rows(x, _fallback(spark, sf), F.col("fetched_at"), STANDIN_BOUNDS)


@register("ana08_market_prices", sql(rnd("SELECT * FROM market_prices", ["price_low_usd", "price_high_usd",
                                                                         "price_mid_usd", "original_cost_usd"]),
                                     PAGES_CTE))
def ana08_market_prices(spark, sf):
    return finish(_market_prices(spark, sf))


@register("ana09_latest_used_prices", sql(rnd("""
SELECT model, condition, price_low_usd, price_high_usd, price_mid_usd, original_cost_usd, source,
  strftime(fetched_at, '%d %b %Y %H:%M') || ' UTC' AS fetched_at_text,
  CAST(round(CAST(price_mid_usd / original_cost_usd * 100.0 AS DECIMAL(28,10)), 1) AS DOUBLE) AS pct_of_original
FROM (SELECT DISTINCT ON (model, condition) * FROM market_prices ORDER BY model, condition, fetched_at DESC)
WHERE condition = 'used_good'""", ["price_low_usd", "price_high_usd", "price_mid_usd", "original_cost_usd"]),
    PAGES_CTE))
def ana09_latest_used_prices(spark, sf):
    return finish(market.latest_prices(_market_prices(spark, sf), "used_good"))


@register("agg13_decision_summary", sql("""
SELECT decision, count(*) AS n,
  CAST(round(CAST(avg(health_score) AS DECIMAL(28,10)), 1) AS DOUBLE) AS avg_health,
  CAST(round(CAST(avg(npv_sell) AS DECIMAL(28,10)), 0) AS DOUBLE) AS avg_sell,
  CAST(round(CAST(avg(npv_keep) AS DECIMAL(28,10)), 0) AS DOUBLE) AS avg_keep
FROM decisions GROUP BY decision ORDER BY n DESC, decision""", ECON_CTES))
def agg13_decision_summary(spark, sf):
    return market.decision_summary(_decisions(spark, sf)[1])


@register("agg14_model_breakdown", sql("""
WITH judged AS (SELECT model, decision, overall_score FROM decisions JOIN health USING (gpu_uuid) JOIN gpu_assets USING (gpu_uuid)),
 per_model AS (SELECT model, count(*) AS devices, count(*) FILTER (decision = 'sell') AS selling, count(*) FILTER (decision = 'keep') AS keeping,
   count(*) FILTER (decision = 'repurpose') AS repurposing, avg(overall_score) AS score FROM judged GROUP BY model)
SELECT model, devices, selling, keeping, repurposing, CAST(round(CAST(score AS DECIMAL(28,10)), 1) AS DOUBLE) AS mean_score,
  CAST(round(CAST(selling / devices * 100.0 AS DECIMAL(28,10)), 1) AS DOUBLE) AS selling_pct FROM per_model""", ECON_CTES))
def agg14_model_breakdown(spark, sf):
    """The scores are worked out once, for the decisions and for the means."""
    scores = store(_score_history(spark, sf), "score-history")
    t, d = _decisions(spark, sf, scores)
    return market.model_breakdown(d, scores, t["assets"])


@register("ana07_temperature_forecast", sql(rnd(f"""
WITH fl AS (SELECT DISTINCT ON (gpu_uuid) gpu_uuid, time, gpu_temp FROM gpu_metrics, as_of
            WHERE time <= as_of ORDER BY gpu_uuid, time DESC),
 ft AS (SELECT gpu_uuid,  -- one point: NULL slope as in PostgreSQL (DuckDB alone returns NaN)
          CASE WHEN count(gpu_temp) < 2 THEN NULL
               ELSE regr_slope(gpu_temp, (epoch_us(time) - epoch_us(as_of)) / 60000000.0::DOUBLE) END AS slope
        FROM gpu_metrics, as_of WHERE time > as_of - INTERVAL '{P['recent']}' AND time <= as_of GROUP BY 1)
SELECT fl.gpu_uuid, fl.time + to_seconds(CAST(s * 60 AS BIGINT)) AS time, CAST(s AS INTEGER) AS step,
  fl.gpu_temp + ft.slope * s AS predicted
FROM fl LEFT JOIN ft USING (gpu_uuid), range(0, 31) r(s)""", ["predicted"])))
def ana07_temperature_forecast(spark, sf):
    m = load_fleet(spark, sf)["metrics"]
    a = as_of_col(m)
    return finish(forecast.linear_forecast(m, "gpu_temp", a, 30, 60.0, P["recent"]))


@register("set02_health_components", sql("""
SELECT gpu_uuid, 'Thermal' AS component, thermal_health AS current_score, 85.0::DOUBLE AS baseline FROM health
UNION ALL SELECT gpu_uuid, 'Memory', memory_health, 85.0::DOUBLE FROM health
UNION ALL SELECT gpu_uuid, 'Performance', performance_health, 85.0::DOUBLE FROM health
UNION ALL SELECT gpu_uuid, 'Power', power_health, 85.0::DOUBLE FROM health
UNION ALL SELECT gpu_uuid, 'Reliability', reliability_health, 85.0::DOUBLE FROM health""", HEALTH_CTE))
def set02_health_components(spark, sf):
    return forecast.components_long(_health(spark, sf)[2])

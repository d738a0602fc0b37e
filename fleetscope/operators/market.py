"""Secondary-market prices: extraction from page text, sanity bounds with fallback
rows, latest prices and decision summaries (SRC6, PRJ21, FLT10, ANA8, ANA9, AGG13, AGG14, PRJ13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.columns import money_to_double, round_numeric
from fleetscope.operators.health import round_half_up
from fleetscope.operators.latest import latest_per_key

# Price patterns. A range is "$X - $Y" with a hyphen, en dash or em
# dash; a single price is "$X"; amounts may carry thousands commas.
AMOUNT = r"\$[\d,]+"
RANGE = r"\$[\d,]+\s*[-–—]\s*\$[\d,]+"
USED_SECTION = r"(?s)[Uu]sed.*?(" + RANGE + r")"
SECONDARY_SECTION = r"(?s)[Ss]econdary.*?(" + RANGE + r")"

# Sections tried in order, and whether any price on the page will do.
PRICE_RULES = {
    "NVIDIA A100-SXM4-80GB": ((USED_SECTION,), True),
    "NVIDIA H100-SXM5-80GB": ((SECONDARY_SECTION, USED_SECTION), False),
}
DEFAULT_RULE = ((SECONDARY_SECTION, USED_SECTION), True)

# Sanity bounds per model (low and high must both fall inside).
PRICE_BOUNDS = {
    "NVIDIA A100-SXM4-80GB": (1000, 50000),
    "NVIDIA H100-SXM5-80GB": (5000, 100000),
}
# Fallback rows per model.
FALLBACK_PRICES = {
    "NVIDIA A100-SXM4-80GB": ("used_good", 7000.00, 10000.00, 8500.00, 15000.00),
    "NVIDIA H100-SXM5-80GB": ("used_good", 20000.00, 28000.00, 24000.00, 32000.00),
}


def page_text(html: Column) -> Column:
    """Visible text of a page: tags become spaces, whitespace collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def parse_range(text: Column) -> Column:
    """First ``$X-$Y`` -> (low, high, mid = round((low+high)/2, 2)); else first ``$X`` -> (x, x, x)."""
    rng = F.regexp_extract(text, RANGE, 0)
    lo = money_to_double(F.regexp_extract(rng, r"(\$[\d,]+)", 1))
    hi = money_to_double(F.regexp_extract(rng, r"[-–—]\s*(\$[\d,]+)", 1))
    one = money_to_double(F.regexp_extract(text, AMOUNT, 0))
    has_range = (rng != "") & lo.isNotNull() & hi.isNotNull()
    return (F.when(has_range, F.struct(lo.alias("low"), hi.alias("high"),
                                       round_half_up((lo + hi) / 2.0, 2).alias("mid")))
            .when(one.isNotNull(), F.struct(one.alias("low"), one.alias("high"), one.alias("mid"))))


def _price_source(text: Column, sections, anywhere: bool) -> Column:
    """The text to read a price from: the first section that matches; else, if ``anywhere``, the page."""
    picks = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in sections]
    return F.coalesce(*picks, text if anywhere else F.lit(None).cast("string"))


def extract_prices(pages: DataFrame, html_col: str = "html", model_col: str = "model") -> DataFrame:
    """Add ``price`` (low, high, mid) from a page by its model's rule in ``PRICE_RULES`` (SRC6);
    models without one take ``DEFAULT_RULE``."""
    d = pages.withColumn("_text", page_text(F.col(html_col)))
    source = _price_source(F.col("_text"), *DEFAULT_RULE)
    for model, rule in PRICE_RULES.items():
        source = F.when(F.col(model_col) == model, _price_source(F.col("_text"), *rule)).otherwise(source)
    d = d.withColumn("_source", source)
    return d.withColumn("price", parse_range(F.col("_source"))).drop("_text", "_source")


def _bounds(model: Column, default=(None, None)) -> tuple[Column, Column]:
    lo = hi = None
    for m, (a, b) in PRICE_BOUNDS.items():
        lo = F.when(model == m, F.lit(float(a))) if lo is None else lo.when(model == m, F.lit(float(a)))
        hi = F.when(model == m, F.lit(float(b))) if hi is None else hi.when(model == m, F.lit(float(b)))
    return lo.otherwise(F.lit(default[0]).cast("double")), hi.otherwise(F.lit(default[1]).cast("double"))


def price_rows(extracted: DataFrame, fallback: DataFrame, fetched_at: Column, default_bounds=(None, None)) -> DataFrame:
    """``gpu_market_prices`` rows (ANA8 + FLT10): scraped when inside the model's
    bounds, else the model's fallback row with ``source='fallback'``; models
    without a fallback and without a sane price produce no row."""
    lo_b, hi_b = _bounds(F.col("model"), default_bounds)
    p = F.col("price")
    inside = lambda c: (lo_b.isNull() | (c >= lo_b)) & (hi_b.isNull() | (c <= hi_b))
    ok = p.isNotNull() & inside(p["low"]) & inside(p["high"])
    fb = fallback.select("model", "condition", F.col("low").alias("_fl"), F.col("high").alias("_fh"),
                         F.col("mid").alias("_fm"), F.col("original_cost_usd").alias("_fo"))
    d = extracted.join(fb, ["model", "condition"], "left")
    out = d.select(
        fetched_at.alias("fetched_at"), "model", "condition",
        F.when(ok, p["low"]).otherwise(F.col("_fl")).alias("price_low_usd"),
        F.when(ok, p["high"]).otherwise(F.col("_fh")).alias("price_high_usd"),
        F.when(ok, p["mid"]).otherwise(F.col("_fm")).alias("price_mid_usd"),
        F.coalesce(F.col("_fo"), F.col("original_cost_usd")).alias("original_cost_usd"),
        F.when(ok, F.lit("web_scrape")).when(F.col("_fl").isNotNull(), F.lit("fallback")).alias("source"))
    return out.where(F.col("source").isNotNull())


def latest_prices(prices: DataFrame, condition: str | None = "used_good") -> DataFrame:
    """``v_latest_market_prices`` (+ condition filter) with percent of original (ANA9, PRJ13)."""
    last = latest_per_key(prices, ["model", "condition"], "fetched_at")
    if condition is not None:
        last = last.where(F.col("condition") == condition)
    return last.select(
        "model", "condition", "price_low_usd", "price_high_usd", "price_mid_usd", "original_cost_usd", "source",
        F.concat(F.date_format("fetched_at", "dd MMM yyyy HH:mm"), F.lit(" UTC")).alias("fetched_at_text"),
        round_numeric(F.try_divide(F.col("price_mid_usd"), F.col("original_cost_usd")) * 100.0, 1)
        .alias("pct_of_original"))


def decision_summary(decisions: DataFrame) -> DataFrame:
    """Latest decision per device, grouped by decision (AGG13)."""
    last = latest_per_key(decisions, "gpu_uuid", "time", ["decision", "health_score", "npv_sell", "npv_keep"])
    return (last.groupBy("decision")
            .agg(F.count(F.lit(1)).alias("n"), round_numeric(F.avg("health_score"), 1).alias("avg_health"),
                 round_numeric(F.avg("npv_sell"), 0).alias("avg_sell"),
                 round_numeric(F.avg("npv_keep"), 0).alias("avg_keep"))
            .orderBy(F.col("n").desc(), "decision"))


def model_breakdown(decisions: DataFrame, scores: DataFrame, assets: DataFrame) -> DataFrame:
    """Per-model decision counts and mean health, with the sell share (AGG14, JON6)."""
    d = latest_per_key(decisions, "gpu_uuid", "time", ["decision"])
    h = latest_per_key(scores, "gpu_uuid", "time", ["overall_score"])
    j = assets.select("gpu_uuid", "model").join(d, "gpu_uuid").join(h, "gpu_uuid")
    on = lambda what: F.count_if(F.col("decision") == what)
    per = j.groupBy("model").agg(F.count(F.lit(1)).alias("devices"), on("sell").alias("selling"), on("keep").alias("keeping"), on("repurpose").alias("repurposing"),
                                 round_numeric(F.avg("overall_score"), 1).alias("mean_score"))
    return per.withColumn("selling_pct", round_numeric(F.col("selling") / F.col("devices") * 100.0, 1)).orderBy("model")

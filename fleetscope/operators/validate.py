"""Event validation with a dead-letter output (VAL1-VAL8, SNK1, STR2).

Validation reads the JSON text itself: ``json_object_keys`` tells a present key
from an absent one (a parsed struct cannot), and ``get_json_object`` returns a
value's own text for error messages. Every rule is a Column expression; the
result is an ``errors`` array per event and valid iff it is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.columns import parse_iso_ts, round_numeric, seconds_between
from fleetscope.operators.ingest import EVENT_SCHEMA, iso_text

# Required keys and sections, and the numeric bounds of the rules.
REQUIRED_FIELDS = ["schema_version", "event_type", "timestamp", "gpu", "host", "metrics"]
REQUIRED_SECTIONS = ["health", "memory", "performance", "clocks"]
TEMP_RANGE = (0, 120)
POWER_RANGE = (0, 800)
PCT_RANGE = (0, 100)
SM_CLOCK_RANGE = (100, 3000)
MAX_AGE_SECONDS = 3600
MAX_AHEAD_SECONDS = 300
VALIDATOR_VERSION = "1.0"


def _get(v: Column, path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(v, path, typ)


def _present(v: Column, path: str) -> Column:
    """Key exists (a JSON null counts as present, as ``key in dict`` does)."""
    return _get(v, path).isNotNull()


def _num_text(x: Column) -> Column:
    """A JSON number as Python prints it: integers bare, floats with a decimal point."""
    integral = F.schema_of_variant(x).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    return F.when(integral, _get(x, "$", "long").cast("string")).otherwise(_get(x, "$", "double").cast("string"))


def _num(v: Column, path: str) -> tuple[Column, Column]:
    """(number with absent -> 0, text for messages) of a path."""
    x = _get(v, path)
    return F.coalesce(_get(v, path, "double"), F.lit(0.0)), F.coalesce(_num_text(x), F.lit("0"))


def _out_of_range(v: Column, path: str, lo, hi, msg: str) -> Column:
    num, text = _num(v, path)
    return F.when(~num.between(lo, hi), F.format_string(msg, text))


def _null_metric(v: Column, section: str, field: str) -> Column:
    """Present key holding JSON null -> error (the reference drops such events silently)."""
    x = _get(v, f"$.metrics.{section}.{field}")
    return F.when(x.isNotNull() & F.is_variant_null(x), F.lit(f"Null metric: metrics.{section}.{field}"))


# The fields that the rules read, as one typed view of an event.
CHECKED_FIELDS = """struct<schema_version:string, event_type:string, timestamp:string, gpu:struct<gpu_uuid:string>,
  host:struct<hostname:string>, metrics:struct<
    health:struct<gpu_temp_c:double, memory_temp_c:double, power_usage_w:double>,
    memory:struct<fb_used_mib:double, fb_free_mib:double, utilization_pct:double>,
    performance:map<string,string>, clocks:struct<sm_clock_mhz:double>>>"""


def passes(f: Column) -> Column:
    """No schema and no range rule can fire: every field of the view ``f`` (``CHECKED_FIELDS``)
    is there, with a value in range. False where in doubt (absent, null or of another type,
    ``performance`` values included); the rules themselves then decide."""
    m = f["metrics"]
    health, mem, clk = m["health"], m["memory"], m["clocks"]["sm_clock_mhz"]
    perf = F.forall(F.map_entries(m["performance"]), lambda kv: ~(kv["key"].endswith("_pct") | kv["key"].contains("active"))
                    | kv["value"].try_cast("double").between(*PCT_RANGE))
    ok = (f["schema_version"].isNotNull() & f["event_type"].isNotNull() & f["timestamp"].isNotNull()
          & f["host"].isNotNull() & (f["gpu"]["gpu_uuid"] != "")
          & health["gpu_temp_c"].between(*TEMP_RANGE) & health["memory_temp_c"].between(*TEMP_RANGE)
          & health["power_usage_w"].between(*POWER_RANGE)
          & (mem["fb_used_mib"] >= 0) & (mem["fb_free_mib"] >= 0) & mem["utilization_pct"].between(*PCT_RANGE)
          & ((clk <= 0) | clk.between(*SM_CLOCK_RANGE)) & perf)
    return F.coalesce(ok, F.lit(False))


def schema_errors(v: Column) -> Column:
    """VAL1 + VAL2 on the parsed event: missing top-level keys stop here; else
    uuid / empty metrics / missing sections. Unparsable text is one error."""
    missing = F.array_compact(F.array(*[
        F.when(~_present(v, f"$.{f}"), F.lit(f"Missing required field: {f}")) for f in REQUIRED_FIELDS]))
    uuid = _get(v, "$.gpu.gpu_uuid", "string")
    msize = F.coalesce(F.size(_get(v, "$.metrics", "map<string,variant>")), F.lit(0))
    second = F.array_compact(F.array(
        F.when(F.coalesce(uuid, F.lit("")) == "", F.lit("Missing gpu.gpu_uuid")),
        F.when(msize <= 0, F.lit("Empty metrics object")),
        *[F.when(~_present(v, f"$.metrics.{s}"), F.lit(f"Missing metrics.{s}")) for s in REQUIRED_SECTIONS]))
    return (F.when(v.isNull(), F.array(F.lit("Invalid JSON")))
            .when(F.size(missing) > 0, missing).otherwise(second))


def range_errors(v: Column) -> Column:
    """VAL3: inclusive ranges; absent values count as 0; sm clock checked only when > 0."""
    perf = F.map_entries(F.coalesce(_get(v, "$.metrics.performance", "map<string,variant>"),
                                    F.create_map().cast("map<string,variant>")))
    perf_err = F.transform(
        F.filter(perf, lambda kv: (kv["key"].endswith("_pct") | kv["key"].contains("active"))
                 & ~F.coalesce(_get(kv["value"], "$", "double"), F.lit(0.0)).between(*PCT_RANGE)),
        lambda kv: F.format_string("%s out of range: %s%% (expected 0-100)", kv["key"], _num_text(kv["value"])))
    clk, clk_text = _num(v, "$.metrics.clocks.sm_clock_mhz")
    used, used_text = _num(v, "$.metrics.memory.fb_used_mib")
    free, free_text = _num(v, "$.metrics.memory.fb_free_mib")
    fixed = F.array_compact(F.array(
        _out_of_range(v, "$.metrics.health.gpu_temp_c", *TEMP_RANGE,
                      "GPU temperature out of range: %s°C (expected 0-120)"),
        _out_of_range(v, "$.metrics.health.memory_temp_c", *TEMP_RANGE,
                      "Memory temperature out of range: %s°C (expected 0-120)"),
        _out_of_range(v, "$.metrics.health.power_usage_w", *POWER_RANGE,
                      "Power usage out of range: %sW (expected 0-800)"),
        F.when(used < 0, F.format_string("Negative fb_used_mib: %s", used_text)),
        F.when(free < 0, F.format_string("Negative fb_free_mib: %s", free_text)),
        _out_of_range(v, "$.metrics.memory.utilization_pct", *PCT_RANGE,
                      "Memory utilization out of range: %s%% (expected 0-100)"),
    ))
    clock = F.array_compact(F.array(F.when((clk > 0) & ~clk.between(*SM_CLOCK_RANGE),
                                           F.format_string("SM clock out of range: %s MHz (expected 100-3000)",
                                                           clk_text))))
    nulls = F.array_compact(F.array(*[_null_metric(v, s, f) for s, f in (
        ("health", "gpu_temp_c"), ("health", "memory_temp_c"), ("health", "power_usage_w"),
        ("memory", "fb_used_mib"), ("memory", "fb_free_mib"), ("memory", "utilization_pct"),
        ("clocks", "sm_clock_mhz"))]))
    return F.concat(nulls, fixed, perf_err, clock)


def timestamp_errors(raw: Column, ts: Column, now: Column) -> Column:
    """VAL4: present, parseable, not older than 1 h, not more than 5 min ahead of ``now``.

    ``raw`` is the timestamp text and ``ts`` its parsed value (a column computed once).
    """
    age = seconds_between(now, ts)
    return F.array_compact(F.array(
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit("Missing timestamp")),
        F.when((F.coalesce(raw, F.lit("")) != "") & ts.isNull(),
               F.concat(F.lit("Invalid timestamp format: "), raw)),
        F.when(age > MAX_AGE_SECONDS, F.format_string("Event timestamp too old: %.0fs (>1 hour)", age)),
        F.when(age < -MAX_AHEAD_SECONDS, F.format_string("Event timestamp in future: %.0fs", -age)),
    ))


def _once(df: DataFrame, cols: dict) -> DataFrame:
    """Add columns through a one-row ``inline`` generator.

    Filter pushdown substitutes projected expressions into predicates without a
    cost check, which would re-run the JSON parse and the rule arrays inside the
    valid / dead-letter filters. Predicates cannot move below a Generate, so
    each expression here is evaluated exactly once per event.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def validate(raw: DataFrame, now: Column | None = None, value_col: str = "value") -> DataFrame:
    """Add ``errors`` (array) and ``is_valid`` (VAL5): schema errors short-circuit.

    The JSON text is parsed into a VARIANT (``try_parse_json``) and every rule reads
    paths of that binary value. Most events break none: a typed view of the checked
    fields tells that in one pass, and only the others go through the rules.
    """
    now = now if now is not None else F.current_timestamp()
    d = _once(raw, {"_v": F.try_parse_json(F.col(value_col)), "_f": F.from_json(F.col(value_col), CHECKED_FIELDS)})
    v = F.col("_v")
    d = _once(d, {"_ok": v.isNotNull() & passes(F.col("_f")), "_ts_raw": _get(v, "$.timestamp", "string")})
    none = F.array().cast("array<string>")
    d = _once(d, {"_se": F.when(F.col("_ok"), none).otherwise(schema_errors(v)), "_ts": parse_iso_ts(F.col("_ts_raw"))})
    errs = F.when(F.size("_se") > 0, F.col("_se")).otherwise(
        F.concat(F.when(F.col("_ok"), none).otherwise(range_errors(v)), timestamp_errors(F.col("_ts_raw"), F.col("_ts"), now)))
    d = _once(d, {"errors": errs})
    return d.drop("_v", "_f", "_ok", "_se", "_ts_raw", "_ts").withColumn("is_valid", F.size("errors") == 0)


def valid_events(checked: DataFrame, now: Column | None = None, value_col: str = "value") -> DataFrame:
    """Parsed valid events with the validation stamp in ``quality`` (VAL6)."""
    now = now if now is not None else F.current_timestamp()
    e = F.col("_e")  # parsed once: each field below would parse the text again
    q = F.coalesce(e["quality"], F.struct(F.lit(None).cast("int").alias("collection_latency_ms"),
                                          F.lit(None).cast("boolean").alias("stale"),
                                          F.lit(None).cast("int").alias("sample_count"),
                                          F.lit(None).cast("string").alias("error")))
    stamped = e.withField("quality", q.withField("validation_timestamp", iso_text(now))
                          .withField("validation_version", F.lit(VALIDATOR_VERSION))
                          .withField("validation_passed", F.lit(True)))
    keep = [c for c in checked.columns if c not in (value_col, "errors", "is_valid")]
    ok = _once(checked.where("is_valid"), {"_e": F.from_json(F.col(value_col), EVENT_SCHEMA)})
    return ok.select(*keep, stamped.alias("e"))


def dead_letters(checked: DataFrame, now: Column | None = None, value_col: str = "value") -> DataFrame:
    """Dead-letter records ``{original_event, validation_errors, timestamp, validator_version}`` (VAL6)."""
    now = now if now is not None else F.current_timestamp()
    keep = [c for c in checked.columns if c not in (value_col, "errors", "is_valid")]
    return checked.where(~F.col("is_valid")).select(
        *keep, F.struct(F.col(value_col).alias("original_event"), F.col("errors").alias("validation_errors"),
                        iso_text(now).alias("timestamp"), F.lit(VALIDATOR_VERSION).alias("validator_version"))
        .alias("dead_letter"))


def error_breakdown(checked: DataFrame) -> DataFrame:
    """Error counts by type (text before ``:``) plus valid/invalid totals with their
    percentage of all events (VAL7): totals first, then error types, most frequent first.

    One pass: each event emits its error types and one ``__valid__`` /
    ``__invalid__`` tag, and a single partial aggregation counts them.
    """
    types = F.transform("errors", lambda e: F.split_part(e, F.lit(":"), F.lit(1)))
    tag = F.array(F.when(F.col("is_valid"), F.lit("__valid__")).otherwise(F.lit("__invalid__")))
    return (checked.select(F.explode(F.concat(types, tag)).alias("error_type"))
            .groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
            .transform(_with_percentages))


def _with_percentages(counts: DataFrame) -> DataFrame:
    """A row per error type and tag: few rows, so the total is a window over them. (A subquery
    would validate all events again: its filter on the tag makes it another plan.)"""
    tag = F.col("error_type").startswith("__")
    total = F.sum(F.when(tag, F.col("n"))).over(Window.partitionBy())
    return (counts.withColumn("pct", F.when(tag, round_numeric(F.col("n") / total * 100.0, 1)))
                  .orderBy((~tag).cast("int"), F.col("n").desc(), "error_type"))


def quality_flags(events: DataFrame, now: Column, time_col: str = "time") -> DataFrame:
    """[D] ``quality_flags``: ``late`` (> 1 h old) and ``out_of_range`` (VAL8)."""
    late = seconds_between(now, F.col(time_col)) > MAX_AGE_SECONDS
    oor = ~F.col("gpu_temp").between(*TEMP_RANGE) | ~F.col("power_usage").between(*POWER_RANGE)
    return events.withColumn("quality_flags", F.array_compact(F.array(F.when(late, "late"), F.when(oor, "out_of_range"))))

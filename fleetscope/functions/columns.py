"""Scalar Column expressions (unit conversions, bit tests, grades, clamps, ...).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Throttle-reason bits and their names, in the decode order the
# collector emits them.
THROTTLE_BITS = [
    (3, "HW_SLOWDOWN"),
    (6, "HW_THERMAL"),
    (7, "HW_POWER_BRAKE"),
    (2, "SW_POWER_CAP"),
    (5, "SW_THERMAL"),
]
BIT_HW_THERMAL = 6
BIT_HW_POWER_BRAKE = 7
BIT_SW_POWER_CAP = 2

# Health grade floors (score >= floor), best first.
GRADE_FLOORS = [
    (90, "excellent"),
    (80, "good"),
    (70, "fair"),
    (60, "degraded"),
    (50, "poor"),
]
GRADE_BELOW = "critical"

MIB = 1048576


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bit_set(c, bit: int, null_as_zero: bool = True) -> Column:
    """``(c & (1 << bit)) > 0`` (PRJ5); NULL counts as 0 when ``null_as_zero``."""
    v = col_(c)
    if null_as_zero:
        v = F.coalesce(v, F.lit(0))
    return v.bitwiseAND(F.lit(1 << bit)) > 0


def decode_throttle(c) -> Column:
    """Throttle bitmask -> ordered array of reason names (PRJ4)."""
    v = F.coalesce(col_(c).cast("long"), F.lit(0).cast("long"))
    return F.array_compact(F.array(*[F.when(v.bitwiseAND(F.lit(1 << b)) > 0, F.lit(n)) for b, n in THROTTLE_BITS]))


def mib_to_bytes(c) -> Column:
    """MiB -> bytes, missing -> 0 (PRJ2)."""
    return F.coalesce(col_(c).cast("long"), F.lit(0).cast("long")) * F.lit(MIB)


def memory_util_pct(used, free) -> Column:
    """used/(used+free)*100, 0 when total is 0 (PRJ6)."""
    u, f = col_(used).cast("double"), col_(free).cast("double")
    return F.coalesce(F.try_divide(u, F.nullif(u + f, F.lit(0.0))) * F.lit(100.0), F.lit(0.0))


def uuid_gpu_id(uuid) -> Column:
    """Second ``-`` token of the device uuid (PRJ7)."""
    return F.element_at(F.split(col_(uuid), "-"), 2)


def pci_bus_id(index) -> Column:
    """``0000:%02X:00.0`` with 0x3B + device index (PRJ7)."""
    return F.format_string("0000:%02X:00.0", col_(index) + F.lit(0x3B))


def parse_iso_ts(c) -> Column:
    """ISO-8601 text (``Z`` or offset) -> timestamp, NULL when unparsable (PRJ8)."""
    s = F.regexp_replace(col_(c), "Z$", "+00:00")
    return F.coalesce(
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
    )


def seconds_between(later, earlier) -> Column:
    """(later - earlier) in seconds as double (PRJ9)."""
    return (F.unix_micros(col_(later).cast("timestamp")) - F.unix_micros(col_(earlier).cast("timestamp"))) / F.lit(1e6)


def days_floor(later, earlier) -> Column:
    """Python ``timedelta.days``: floor of the day difference, negatives too (PRJ19)."""
    return F.floor(seconds_between(later, earlier) / F.lit(86400.0)).cast("int")


def round_numeric(c, n: int) -> Column:
    """``ROUND(x::numeric, n)``: half away from zero on the decimal value (PRJ10)."""
    return F.round(col_(c).cast("decimal(28,10)"), n).cast("double")


def clamp(c, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Clamp to [lo, hi] (PRJ17)."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col_(c)))


def health_grade(score) -> Column:
    """Score -> grade word (PRJ15)."""
    s = col_(score)
    expr = None
    for floor, name in GRADE_FLOORS:
        expr = F.when(s >= floor, name) if expr is None else expr.when(s >= floor, name)
    return expr.otherwise(GRADE_BELOW)


def severity_level(sev) -> Column:
    """Severity word -> level 1..4 (PRJ16)."""
    s = col_(sev)
    return (F.when(s == "critical", 4).when(s == "high", 3).when(s == "medium", 2)
            .when(s == "low", 1))


def live_status(temp) -> Column:
    """>85 critical, >75 warning, else healthy (PRJ27)."""
    t = col_(temp)
    return F.when(t > 85, "critical").when(t > 75, "warning").otherwise("healthy")


def money_to_double(c) -> Column:
    """``$7,000`` -> 7000.0, NULL when not a number (PRJ21)."""
    return F.trim(F.regexp_replace(col_(c), r"[$,]", "")).try_cast("double")


def json_text_field(c, field: str) -> Column:
    """``tags->>'field'`` of a JSON text column (PRJ11)."""
    return F.get_json_object(col_(c), f"$.{field}")


def epoch_seconds(ts) -> Column:
    """``EXTRACT(EPOCH FROM ts)`` as double seconds (PRJ12)."""
    return F.unix_micros(col_(ts).cast("timestamp")) / F.lit(1e6)


def age_months(later, earlier) -> Column:
    """Whole months between two dates (PRJ12); the reference's ``EXTRACT(MONTH FROM
    interval)`` is 0 for day-based intervals, ``months_between`` is the intended value."""
    return F.floor(F.months_between(col_(later), col_(earlier))).cast("int")

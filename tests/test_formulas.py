"""Hand-computed cases for scoring, prediction and economics formulas."""

import datetime as dt

from pyspark.sql import functions as F

from fleetscope.operators import economics, health, predict

T0 = dt.datetime(2024, 1, 10, 0, 0, 0)
COLS = ("time timestamp, gpu_uuid string, gpu_temp double, memory_temp double, power_usage double, "
        "throttle_reasons long, ecc_sbe_volatile int, ecc_dbe_volatile int, retired_pages_dbe int, "
        "sm_active double, sm_occupancy double, dram_active double")


def rows(n, **kw):
    base = dict(gpu_temp=60.0, memory_temp=65.0, power_usage=300.0, throttle_reasons=0, ecc_sbe_volatile=0,
                ecc_dbe_volatile=0, retired_pages_dbe=0, sm_active=50.0, sm_occupancy=40.0, dram_active=30.0)
    out = []
    for i in range(n):
        r = dict(base)
        for k, v in kw.items():
            r[k] = v(i) if callable(v) else v
        out.append((T0 + dt.timedelta(seconds=10 * i), "G", r["gpu_temp"], r["memory_temp"], r["power_usage"],
                    r["throttle_reasons"], r["ecc_sbe_volatile"], r["ecc_dbe_volatile"], r["retired_pages_dbe"],
                    r["sm_active"], r["sm_occupancy"], r["dram_active"]))
    return out


def score(spark, data, **kw):
    df = spark.createDataFrame(data, COLS)
    as_of = max(r[0] for r in data)
    params = dict(lookback_days=1, active="1 hour", gap_seconds=300, sample_seconds=10)
    params.update(kw)
    return health.health_scores(df, F.lit(as_of), **params).collect()[0]


def test_healthy_device_full_completeness(spark):
    # 8640 samples = complete day at 10 s: every dimension 100
    r = score(spark, rows(8640))
    assert (r.memory_health, r.thermal_health, r.performance_health, r.power_health, r.reliability_health) == \
        (100.0, 100.0, 100.0, 100.0, 100.0)
    assert r.overall_score == 100.0 and r.health_grade == "excellent"
    assert r.degradation_factors == []


def test_memory_dimension_branches(spark):
    # latest dbe=2 -> -20; sbe 150 -> -10; retired 3 -> -15; dram 100 then 50 -> degradation .5 -> -50
    data = rows(48, dram_active=lambda i: 100.0 if i < 24 else 50.0, ecc_dbe_volatile=2, ecc_sbe_volatile=150,
                retired_pages_dbe=3)
    r = score(spark, data, sample_seconds=1800)  # 48 expected samples: completeness 1
    assert r.memory_health == 5.0  # 100 - 20 - 10 - 15 - 50
    assert r.degradation_factors[:3] == ["uncorrectable_ecc_errors", "high_correctable_ecc_errors",
                                         "retired_memory_pages"]
    assert "memory_degradation" in r.degradation_factors


def test_thermal_branches_and_throttle(spark):
    # avg 90 -> -10; max 90; 10 of 48 rows bit 6 set: throttle 20.8 % -> -20.8, hw thermal -> -20
    data = rows(48, gpu_temp=90.0, throttle_reasons=lambda i: 64 if i < 10 else 0)
    r = score(spark, data, sample_seconds=1800)
    assert r.thermal_health == round(100 - 10 - 10 / 48 * 100 - 20, 1)
    assert "elevated_temperature" in r.degradation_factors and "thermal_throttling" in r.degradation_factors


def test_power_and_performance(spark):
    # occupancy 10 with sm 50 -> -(30-10)*.5 = -10; all rows bit 2 -> -10; bit 7 once -> -15
    data = rows(48, sm_occupancy=10.0, throttle_reasons=lambda i: 4 if i else 128)
    r = score(spark, data, sample_seconds=1800)
    assert r.performance_health == 90.0
    assert r.power_health == 75.0  # -15 (brake); sw cap rows 47 > 24 -> -10


def test_reliability_gaps(spark):
    data = rows(10)
    data = data[:5] + [(t + dt.timedelta(seconds=600), *rest) for (t, *rest) in data[5:]]
    r = score(spark, data, sample_seconds=86400 / 10.0)  # expected 10 samples in the day
    assert r.reliability_health == 95.0  # one gap > 300 s


def test_grade_from_unrounded_score(spark):
    from fleetscope.functions.columns import health_grade
    got = spark.range(1).select(health_grade(F.lit(89.96)).alias("g")).first().g
    assert got == "good"  # 89.96 rounds to 90.0 for display but the grade uses the raw value


def test_npv_keep_matches_loop(spark):
    # keep NPV with health 85, p90 .2, util 60 %, fair 12000: same value as the plain loop
    def loop(h, p90, util, fair):
        md = 1.1 ** (1 / 12) - 1
        pc = 0.35 * 730 * 0.12 * 1.3
        npv = 0.0
        for m in range(12):
            net = 730 * 3.0 * (util / 100) - (pc + 50)
            npv += (net * max(0.2, (h - m * 2) / 100) - min(p90, 0.6) * fair / 12) * (1 / ((1 + md) ** m))
        return npv
    got = spark.range(1).select(economics.npv_keep(F.lit(85.0), F.lit(0.2), F.lit(60.0), F.lit(12000.0))
                                .alias("v")).first().v
    assert abs(got - loop(85.0, 0.2, 60.0, 12000.0)) < 1e-6


def test_heuristic_prediction_and_type(spark):
    df = spark.createDataFrame([(T0, "G", 86.0, 25, 1, 120, 800, 12)],
                               "time timestamp, gpu_uuid string, gpu_temp_mean double, thermal_throttle_count int, "
                               "ecc_dbe_event_count int, ecc_sbe_event_count int, gpu_age_days int, "
                               "power_brake_count int")
    r = predict.predict_failures(df, F.lit(T0)).collect()[0]
    assert r.failure_prob_30d == 0.95  # .4 + .3 + .5 + .2 + .1 capped
    assert r.failure_prob_7d == round(0.95 * 0.25, 4) and r.failure_prob_90d == 0.99
    assert r.estimated_ttf_days == int(30 / 0.95)
    assert r.predicted_failure_type == "memory"  # memory .8 > thermal .8? tie -> memory first
    assert r.model_name == "heuristic"

"""Histogram refinement against sorted values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fleetscope.operators.quantile import exact_quantiles
from fleetscope.operators.rollups import bucket_percentile

SHARES = {"lowest": 0.0, "p05": 0.05, "median": 0.5, "p95": 0.95, "highest": 1.0}


def brute(values, p):
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    if not v:
        return None
    rank = (len(v) - 1) * p
    a, z = v[math.floor(rank)], v[math.ceil(rank)]
    return a if a == z or (math.isnan(a) and math.isnan(z)) else a + (z - a) * (rank - math.floor(rank))


def same(a, b):
    return a == b or (a is not None and b is not None and ((math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1e-12 * max(abs(a), abs(b))))


@pytest.mark.parametrize("bins, few", [(7, 60), (1024, 1), (16, 4096)])
def test_matches_sorted_values(spark, bins, few):
    rnd = random.Random(bins)
    inf = math.inf
    data = {"even": [float(i) for i in range(500)], "ties": [float(rnd.randrange(5)) for _ in range(300)], "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 40,
            "gauss": [rnd.gauss(0, 1) for _ in range(400)], "wide": [10.0 ** rnd.randrange(-9, 9) * rnd.choice([-1, 1]) for _ in range(80)],
            "ends": [-1.7e308, 1.7e308] + [5e-324, -5e-324] * (few >= 60), "odd": [-inf, inf, math.nan, 1.0, 2.0, None, inf], "infinite": [inf, inf], "nulls": [None, None]}
    rows = [(b, v) for b, vs in data.items() for v in vs]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "b string, v double").repartition(5)
    got = {r.b: r for r in exact_quantiles(df, F.col("b"), F.col("v"), SHARES, bins, few).collect()}
    assert set(got) == set(data) - {"nulls"}
    for b, vs in data.items():
        for name, p in SHARES.items() if b in got else ():
            assert same(got[b][name], brute(vs, p)), (b, name, got[b][name], brute(vs, p))


def test_a_million_distinct_values_in_one_bucket(spark):
    n = 1_000_000
    values = F.pmod(F.col("id") * 7_919, F.lit(n)).cast("double") / 3
    df = spark.range(n).select(F.lit("2024-01-01").cast("timestamp").alias("time"), values.alias("gpu_temp"))
    row = bucket_percentile(df, "1 day", "gpu_temp", 0.95).first()
    assert abs(row.value - 0.95 * (n - 1) / 3) < 1e-6


def test_no_window_holds_a_bucket(spark):
    df = spark.range(3000).select(F.lit(1).alias("b"), F.rand(1).alias("v"))
    out = exact_quantiles(df, F.col("b"), F.col("v"), {"q": 0.9})
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    assert exact_quantiles(spark.createDataFrame([], "b int, v double"), F.col("b"), F.col("v"), {"q": 0.5}).count() == 0

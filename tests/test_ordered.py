"""Skew-safe ordered helpers against brute force, with a hot device spanning
many buckets and samples exactly on bucket boundaries."""

import datetime as dt
import random

import pandas as pd

from fleetscope.operators.latest import first_n_per_key, latest_n_per_key, latest_per_key
from fleetscope.operators.ordered import gap_counts, index_slope, with_row_index

T0 = dt.datetime(2024, 1, 1)


def make(spark, seed=7):
    rnd = random.Random(seed)
    rows = []
    for dev, n in (("hot", 3000), ("a", 40), ("b", 1), ("c", 2)):
        t = T0
        for i in range(n):
            t = t + dt.timedelta(seconds=rnd.choice([10, 10, 10, 400, 3600, 86400 - 5]))
            rows.append((dev, t, float(rnd.randint(30, 90)) if rnd.random() > 0.05 else None))
    rows.append(("a", dt.datetime(2024, 1, 2), 50.0))  # exactly on a bucket boundary
    return rows, spark.createDataFrame(rows, "gpu_uuid string, time timestamp, v double")


def test_gap_counts_match_bruteforce(spark):
    rows, df = make(spark)
    pdf = pd.DataFrame(rows, columns=["gpu_uuid", "time", "v"]).sort_values(["gpu_uuid", "time"])
    exp = pdf.groupby("gpu_uuid")["time"].apply(lambda s: int((s.diff().dt.total_seconds() > 300).sum())).to_dict()
    got = {r.gpu_uuid: r.gap_count for r in gap_counts(df, "gpu_uuid", "time", 300).collect()}
    assert got == exp


def test_row_index_and_slope(spark):
    rows, df = make(spark)
    pdf = pd.DataFrame(rows, columns=["gpu_uuid", "time", "v"]).sort_values(["gpu_uuid", "time"])
    pdf["idx"] = pdf.groupby("gpu_uuid").cumcount()
    got = with_row_index(df, "gpu_uuid", "time").toPandas().sort_values(["gpu_uuid", "time"])
    assert list(got["row_index"]) == list(pdf["idx"])
    slopes = {r.gpu_uuid: r.slope for r in index_slope(df, "v", "gpu_uuid", "time").collect()}
    for dev, g in pdf.groupby("gpu_uuid"):
        ok = g.dropna(subset=["v"])
        if len(g) < 3:
            assert slopes[dev] == 0.0
            continue
        x, y = ok["idx"].astype(float), ok["v"]
        exp = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        assert abs(slopes[dev] - exp) < 1e-9


def test_head_tail_and_latest(spark):
    rows, df = make(spark)
    pdf = pd.DataFrame(rows, columns=["gpu_uuid", "time", "v"]).sort_values(["gpu_uuid", "time"])
    head = first_n_per_key(df, 24).toPandas()
    tail = latest_n_per_key(df, 24).toPandas()
    for dev, g in pdf.groupby("gpu_uuid"):
        assert sorted(head[head.gpu_uuid == dev]["time"]) == sorted(g["time"].head(24))
        assert sorted(tail[tail.gpu_uuid == dev]["time"]) == sorted(g["time"].tail(24))
    last = {r.gpu_uuid: r.time for r in latest_per_key(df, "gpu_uuid", "time", ["v"]).collect()}
    assert all(last[d] == g["time"].max().to_pydatetime() for d, g in pdf.groupby("gpu_uuid"))


def test_window_group_limit_is_partial(spark):
    _, df = make(spark)
    plan = latest_n_per_key(df, 24)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_score_deltas_bruteforce(spark):
    from fleetscope.operators.health import score_deltas
    rnd = random.Random(3)
    rows = []
    for dev in ("x", "y"):
        t = T0
        for i in range(60):
            t = t + dt.timedelta(hours=rnd.choice([6, 12, 24, 30]))
            rows.append((dev, t, float(rnd.randint(40, 100))))
    df = spark.createDataFrame(rows, "gpu_uuid string, time timestamp, overall_score double")
    got = {(r.gpu_uuid, r.time): r for r in score_deltas(df).collect()}
    for dev, t, s in rows:
        prior = [(tt, ss) for d, tt, ss in rows if d == dev and tt <= t - dt.timedelta(days=7)]
        exp = s - max(prior)[1] if prior else None
        g = got[(dev, t)].score_delta_7d
        assert (g is None and exp is None) or abs(g - exp) < 1e-9

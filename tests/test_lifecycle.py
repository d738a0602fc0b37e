"""Alert lifecycle: the rule, the stream against the rule, restart and replay."""

import datetime as dt
import random

from fleetscope.streaming import lifecycle
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
SCHEMA = "time timestamp, gpu_uuid string, failure_prob_7d double, failure_prob_30d double, failure_prob_90d double, confidence double"
PROBS = {"CRITICAL": (0.9, 0.9, 0.95, 0.9), "HIGH": (0.2, 0.8, 0.9, 0.85), "MEDIUM": (0.1, 0.3, 0.6, 0.8), "LOW": (0.0, 0.1, 0.4, 0.6), None: (0.0, 0.0, 0.1, 0.6)}


def run(levels, **options):
    options = {"renew_after": 4 * HOUR, "quiet": 24 * HOUR} | options
    state, events = lifecycle.step("G", None, [(T0 + h * HOUR, level) for h, level in levels], **options)
    return state, [(e["event"], e["level"], (e["time"] - T0) / HOUR) for e in events]


def test_the_rule():
    assert run([(0, "LOW"), (1, "LOW"), (2, "HIGH"), (3, "LOW"), (7, "LOW"), (8, None), (9, None), (10, "LOW")])[1] == [
        ("opened", "LOW", 0), ("escalated", "HIGH", 2), ("renewed", "HIGH", 7), ("closed", "HIGH", 8), ("opened", "LOW", 10)]
    state, events = run([(0, "MEDIUM"), (30, "MEDIUM")])
    assert events == [("opened", "MEDIUM", 0), ("closed", "MEDIUM", 24), ("opened", "MEDIUM", 30)] and state[0] == "MEDIUM"
    assert run([(0, "LOW"), (1, "LOW"), (2, "LOW")])[1] == [("opened", "LOW", 0)]  # repeats within the time give none
    assert run([(5, "LOW"), (4, "HIGH")])[1] == [("opened", "LOW", 5)]  # late


def predictions(seed=2):
    rnd = random.Random(seed)
    rows = []
    for g in range(12):
        t = T0
        for _ in range(40):
            t += rnd.choice([HOUR, 2 * HOUR, 5 * HOUR, 30 * HOUR]) + dt.timedelta(seconds=g)
            rows.append((t, f"G{g}", rnd.choice(["CRITICAL", "HIGH", "MEDIUM", "LOW", "LOW", None])))
    return sorted(rows)


def expected(rows, until):
    out = []
    for g in {r[1] for r in rows}:
        state, events = lifecycle.step(g, None, [(t, level) for t, d, level in rows if d == g], 4 * HOUR, 24 * HOUR)
        if state is not None and state[3] + 24 * HOUR < until:
            events.append({"event": "closed", "gpu_uuid": g, "level": state[0], "time": state[3] + 24 * HOUR})
        out += [(e["gpu_uuid"], e["event"], e["level"], e["time"]) for e in events]
    return sorted(out)


def test_stream_equals_the_rule_over_restarts_and_replays(spark, tmp_path_str):
    rows = predictions()
    src, out, ck = (f"{tmp_path_str}/{x}" for x in ("src", "out", "ck"))
    chunks = [rows[i:i + 120] for i in range(0, len(rows), 120)]
    end = rows[-1][0] + 100 * HOUR
    chunks.append([(end, "other", None)])  # moves the watermark past every timer
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    for chunk in chunks:  # a query that ends and starts again for each file
        spark.createDataFrame([(t, g, *PROBS[level]) for t, g, level in chunk], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        lifecycle.start_alerts(read(), out, ck, available_now=True, lateness="1 hour").awaitTermination()
    stored = spark.read.parquet(out)
    got = sorted((r.gpu_uuid, r.event, r.level, r.time) for r in stored.collect())
    assert got == expected(rows, end - HOUR)
    assert stored.where("event = 'opened'").select("alert_id").distinct().count() == stored.where("event = 'opened'").count()
    batch = stored.where("batch_id = 1")
    kept = [r.asDict() for r in batch.drop("batch_id").collect()]
    lifecycle.write_events(spark.createDataFrame([tuple(k.values()) for k in kept], lifecycle.EVENTS), out, 1)  # the same batch again
    assert sorted((r.gpu_uuid, r.event, r.level, r.time) for r in spark.read.parquet(out).collect()) == got
    assert spark.read.parquet(out).agg(F.countDistinct("batch_id")).first()[0] >= 3

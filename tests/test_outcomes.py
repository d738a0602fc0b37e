"""Outcome tracking against a replay of every device's history."""

import datetime as dt
import random

from fleetscope.operators import outcomes, predict

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def history(seed=4):
    rnd = random.Random(seed)
    alerts, failures = [], []
    for dev, n, m in (("hot", 400, 300), ("a", 10, 4), ("b", 0, 3), ("c", 5, 0), ("d", 1, 1)):
        moments = rnd.sample(range(90 * 24), n + m)
        alerts += [(dev, T0 + dt.timedelta(hours=h)) for h in moments[:n]]
        failures += [(dev, T0 + dt.timedelta(hours=h), float(h)) for h in moments[n:]]
    both = T0 + dt.timedelta(hours=5, minutes=1)
    alerts.append(("same", both)), failures.append(("same", both, 1.0))
    rnd.shuffle(alerts), rnd.shuffle(failures)
    return alerts, failures


def replay(alerts, failures, days):
    """Walk each device's alerts and failures in time order: a failure closes every open alert."""
    hit, warned = {}, {}
    for dev in {a[0] for a in alerts} | {f[0] for f in failures}:
        steps = sorted([(t, 0, None) for d, t, _ in failures if d == dev] + [(t, 1, None) for d, t in alerts if d == dev])
        open_alerts = []
        for t, is_alert, _ in steps:
            open_alerts = [a for a in open_alerts if t - a <= days * DAY]
            if is_alert:
                open_alerts.append(t)
                hit[dev, t] = None
            else:
                warned[dev, t] = open_alerts[0] if open_alerts else None
                for a in open_alerts:
                    hit[dev, a] = t
                open_alerts = []
    return hit, warned


def test_alerts_and_failures_match_a_replay(spark):
    alerts, failures = history()
    hit, warned = replay(alerts, failures, 3)
    a = spark.createDataFrame(alerts, "gpu_uuid string, time timestamp").repartition(3)
    f = spark.createDataFrame(failures, "gpu_uuid string, time timestamp, financial_impact double").repartition(3)
    got = outcomes.failure_outcomes(f, a, 3)
    assert {(r.gpu_uuid, r.time): r.alert_time for r in got.collect()} == warned
    of_alerts = outcomes.alert_outcomes(a, f, 3)
    found = {(r.gpu_uuid, r.time): r.failure_time for r in of_alerts.collect()}
    assert found == hit and any(hit.values()) and not all(hit.values())
    report = outcomes.monthly_outcomes(got, of_alerts, false_alarm_cost=10.0, useful_days=1.0).collect()
    assert len(report) == 3 and sum(r.failures for r in report) == len(failures) and sum(r.alerts for r in report) == len(alerts)
    assert sum(r.predicted for r in report) == sum(v is not None for v in warned.values())
    assert sum(r.false_alarms for r in report) == sum(v is None for v in hit.values())
    lost = sum(i for d, t, i in failures if warned[d, t] is None)
    assert abs(sum(r.missed_cost for r in report) - lost) < 1e-6
    assert all(abs(r.net_value - (r.avoided_cost - r.missed_cost - r.false_alarm_cost)) < 1e-9 for r in report)
    late = sum(v is not None and t - v < DAY for (_, t), v in warned.items())
    assert sum(r.late for r in report) == late


def test_a_month_without_alerts_or_without_failures(spark):
    f = spark.createDataFrame([("a", T0, 5.0)], "gpu_uuid string, time timestamp, financial_impact double")
    a = spark.createDataFrame([("a", T0 + 40 * DAY)], "gpu_uuid string, time timestamp")
    got = {r.month.month: r for r in outcomes.monthly_outcomes(outcomes.failure_outcomes(f, a), outcomes.alert_outcomes(a, f)).collect()}
    assert (got[1].missed, got[1].alerts, got[1].net_value) == (1, 0, -5.0) and (got[2].failures, got[2].false_alarms, got[2].net_value) == (0, 1, -250.0)


def test_first_outcome_before_the_next_decision(spark):
    h = lambda x: T0 + dt.timedelta(hours=x)
    d = spark.createDataFrame([("a", h(0), "sell", 10.0), ("a", h(10), "keep", 1.0), ("a", h(20), "sell", 7.0), ("b", h(0), "sell", 3.0)],
                              "gpu_uuid string, time timestamp, action string, expected_value double")
    e = spark.createDataFrame([("a", h(2), "repurpose", 4.0), ("a", h(3), "sell", 9.0), ("a", h(20), "sell", 8.0), ("a", h(99), "sell", 1.0), ("c", h(1), "sell", 1.0)],
                              "gpu_uuid string, time timestamp, action string, value double")
    got = {(r.gpu_uuid, r.time): (r.decision_executed, r.execution_date, r.executed_action, r.as_decided, r.value_gap) for r in outcomes.decision_outcomes(d, e).collect()}
    assert got == {("a", h(0)): (True, h(2), "repurpose", False, -6.0), ("a", h(10)): (False, None, None, None, None), ("a", h(20)): (True, h(20), "sell", True, 1.0),
                   ("b", h(0)): (False, None, None, None, None)}


def test_labels_with_many_failures_per_device(spark):
    _, failures = history(9)
    rows = [(d, T0 + dt.timedelta(hours=h, minutes=m)) for d in ("hot", "a", "b", "none") for h in range(0, 2400, 7) for m in (0, 30)]
    f = spark.createDataFrame([(d, t, "memory") for d, t, _ in failures], "gpu_uuid string, failure_date timestamp, failure_type string")
    got = predict.labels_within_horizon(spark.createDataFrame(rows, "gpu_uuid string, time timestamp"), f, 2).collect()
    assert len(got) == len(rows)
    times = {d: sorted(t for x, t, _ in failures if x == d) for d in {r[0] for r in rows}}
    for r in got:
        after = [t for t in times[r.gpu_uuid] if t > r.time]
        past = [t for t in times[r.gpu_uuid] if t <= r.time]
        assert r.label == int(bool(after) and after[0] - r.time <= 2 * DAY)
        assert r.lead_days == ((after[0] - r.time) / DAY if after else None) and r.days_since_failure == ((r.time - past[-1]) / DAY if past else None)
        assert r.next_failure_type == ("memory" if after else None)

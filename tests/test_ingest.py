"""Validation, exposition parsing, enrichment and flattening on fixture cases."""

import datetime as dt
import json

from pyspark.sql import functions as F

from fleetscope.operators import enrich, ingest, validate

NOW = dt.datetime(2024, 1, 10, 12, 0, 0)


def event(**over):
    e = {
        "schema_version": "1.0", "event_type": "gpu_metric_sample", "timestamp": "2024-01-10T11:59:00+00:00",
        "gpu": {"gpu_uuid": "GPU-000001", "device_index": 1, "pci_bus_id": "0000:3C:00.0"},
        "host": {"hostname": "h1", "cluster": "", "rack": "", "datacenter": ""},
        "metrics": {"health": {"gpu_temp_c": 60.0, "memory_temp_c": 65.0, "power_usage_w": 300.0},
                    "memory": {"fb_used_mib": 100, "fb_free_mib": 900, "utilization_pct": 10.0},
                    "performance": {"sm_active_pct": 50.0, "dram_active_pct": 30.0},
                    "clocks": {"sm_clock_mhz": 1400}},
        "quality": {"collection_latency_ms": 3},
    }
    for path, v in over.items():
        node = e
        keys = path.split(".")
        for k in keys[:-1]:
            node = node[k]
        if v is KeyError:
            del node[keys[-1]]
        else:
            node[keys[-1]] = v
    return json.dumps(e)


def errors_of(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    return [r.errors for r in validate.validate(df, now=F.lit(NOW)).collect()]


def test_boundaries(spark):
    cases = {
        "ok": event(),
        "t120": event(**{"metrics.health.gpu_temp_c": 120}),
        "t121": event(**{"metrics.health.gpu_temp_c": 121}),
        "tneg": event(**{"metrics.health.gpu_temp_c": -1}),
        "p800": event(**{"metrics.health.power_usage_w": 800}),
        "p801": event(**{"metrics.health.power_usage_w": 801.5}),
        "clk0": event(**{"metrics.clocks.sm_clock_mhz": 0}),
        "clk99": event(**{"metrics.clocks.sm_clock_mhz": 99}),
        "clk3001": event(**{"metrics.clocks.sm_clock_mhz": 3001}),
        "sm101": event(**{"metrics.performance.sm_active_pct": 101}),
        "fbneg": event(**{"metrics.memory.fb_used_mib": -5}),
        "old3600": event(timestamp="2024-01-10T11:00:00+00:00"),
        "old3601": event(timestamp="2024-01-10T10:59:59+00:00"),
        "ahead300": event(timestamp="2024-01-10T12:05:00Z"),
        "ahead301": event(timestamp="2024-01-10T12:05:01Z"),
        "badts": event(timestamp="yesterday"),
        "nouuid": event(**{"gpu.gpu_uuid": ""}),
        "noclocks": event(**{"metrics.clocks": KeyError}),
        "nometa": event(schema_version=KeyError),
        "nullmetric": event(**{"metrics.health.gpu_temp_c": None}),
        "empty_metrics": event(metrics={}),
        "badjson": "{not json",
    }
    got = dict(zip(cases, errors_of(spark, list(cases.values()))))
    assert got["ok"] == [] and got["t120"] == [] and got["p800"] == [] and got["clk0"] == []
    assert got["t121"] == ["GPU temperature out of range: 121°C (expected 0-120)"]
    assert got["tneg"] == ["GPU temperature out of range: -1°C (expected 0-120)"]
    assert got["p801"] == ["Power usage out of range: 801.5W (expected 0-800)"]
    assert got["clk99"] == ["SM clock out of range: 99 MHz (expected 100-3000)"]
    assert got["clk3001"] == ["SM clock out of range: 3001 MHz (expected 100-3000)"]
    assert got["sm101"] == ["sm_active_pct out of range: 101% (expected 0-100)"]
    assert got["fbneg"] == ["Negative fb_used_mib: -5"]
    assert got["old3600"] == [] and got["ahead300"] == []
    assert got["old3601"] == ["Event timestamp too old: 3601s (>1 hour)"]
    assert got["ahead301"] == ["Event timestamp in future: 301s"]
    assert got["badts"] == ["Invalid timestamp format: yesterday"]
    assert got["nouuid"] == ["Missing gpu.gpu_uuid"]
    assert got["noclocks"] == ["Missing metrics.clocks"]
    assert got["nometa"] == ["Missing required field: schema_version"]
    assert got["nullmetric"] == ["Null metric: metrics.health.gpu_temp_c"]
    assert got["empty_metrics"][0] == "Empty metrics object"
    assert got["badjson"] == ["Invalid JSON"]


def test_split_and_enrich_flatten(spark):
    df = spark.createDataFrame([(event(),), (event(**{"metrics.health.gpu_temp_c": 130}),)], "value string")
    checked = validate.validate(df, now=F.lit(NOW))
    assert validate.dead_letters(checked, now=F.lit(NOW)).count() == 1
    ok = validate.valid_events(checked, now=F.lit(NOW))
    assets = spark.createDataFrame([("GPU-000001", "NVIDIA A100-SXM4-80GB", "h9", "r7", "c2", "dc1")],
                                   "gpu_uuid string, model string, hostname string, rack_id string, "
                                   "cluster_id string, datacenter string")
    for c in ["architecture", "compute_capability", "region", "purchase_date", "deployment_date", "warranty_expiry",
              "expected_eol", "sla_tier", "tags", "notes"]:
        assets = assets.withColumn(c, F.lit(None).cast("string"))
    assets = assets.withColumn("memory_gb", F.lit(80)).withColumn("priority", F.lit(1))
    en = enrich.enrich(ok, assets, now=F.lit(NOW)).collect()[0].e
    assert en.host.hostname == "h1" and en.host.rack == "r7" and en.host.datacenter == "dc1"
    assert en.asset.model == "NVIDIA A100-SXM4-80GB" and en.quality.asset_metadata_found
    flat = enrich.flatten(enrich.enrich(ok, assets, now=F.lit(NOW))).collect()[0]
    assert flat.fb_used_bytes == 100 * 1048576 and flat.gpu_utilization == 50.0
    assert abs(flat.mem_copy_utilization - 24.0) < 1e-12 and flat.validation_passed


def test_exposition_parser_cases(spark):
    text = [
        "# HELP x", "", "DCGM_FI_DEV_GPU_TEMP 55",  # comment, blank, no labels
        'DCGM_FI_DEV_GPU_TEMP{gpu="0",modelName="A"} 40',  # no UUID
        'DCGM_FI_DEV_GPU_TEMP{gpu="0",UUID="GPU-a",modelName="NVIDIA A100"} 60 1704067200000',
        'DCGM_FI_DEV_GPU_TEMP{gpu="0",UUID="GPU-a",modelName="other"} 61 1704067200000',  # repeat: last wins
        'DCGM_FI_DEV_POWER_USAGE{gpu="0",UUID="GPU-a"} abc 1704067200000',  # unparsable value
        'DCGM_FI_DEV_GPU_TEMP{gpu="1", UUID="GPU-b" ,modelName="NVIDIA H100"} 70 1704067200000',
    ]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "line_no long, line string")
    got = {r.gpu_uuid: r for r in ingest.parse_exposition(lines).collect()}
    assert set(got) == {"GPU-a", "GPU-b"}
    assert got["GPU-a"].metrics == {"DCGM_FI_DEV_GPU_TEMP": 61.0}
    assert got["GPU-a"].model == "NVIDIA A100" and got["GPU-b"].device_index == 1


def test_exposition_without_timestamps_and_bad_labels(spark):
    text = [
        ("s1", 1, 'DCGM_FI_DEV_GPU_TEMP{gpu="0",UUID="G0",modelName="A"} 50.5'),
        ("s1", 2, 'DCGM_FI_DEV_POWER_USAGE{gpu="0",UUID="G0",modelName="A"} 300 1700000000000'),
        ("s1", 3, 'DCGM_FI_DEV_GPU_TEMP{gpu="x",UUID="G0",modelName="A"} 99'),   # index is no integer: skipped
        ("s1", 4, 'DCGM_FI_DEV_GPU_TEMP{UUID="G1"} 61'),                          # no index: 0
        ("s1", 5, 'DCGM_FI_DEV_GPU_TEMP{gpu="3",UUID=""} 61'),
        ("s1", 6, 'DCGM_FI_DEV_GPU_TEMP{gpu="3",UUID="G2"}'),                     # no value
        ("s2", 1, 'DCGM_FI_DEV_GPU_TEMP{gpu="0",UUID="G0",modelName="A"} 51.5')]
    at = {"s1": dt.datetime(2024, 1, 1), "s2": dt.datetime(2024, 1, 1, 0, 0, 10)}
    lines = spark.createDataFrame([(s, at[s], n, x) for s, n, x in text], "scrape_id string, scraped_at timestamp, line_no long, line string")
    got = {(r.gpu_uuid, r.time): (r.device_index, r.model, dict(r.metrics)) for r in ingest.parse_exposition(lines).collect()}
    assert got == {
        ("G0", at["s1"]): (0, "A", {"DCGM_FI_DEV_GPU_TEMP": 50.5, "DCGM_FI_DEV_POWER_USAGE": 300.0}),
        ("G1", at["s1"]): (0, None, {"DCGM_FI_DEV_GPU_TEMP": 61.0}),
        ("G0", at["s2"]): (0, "A", {"DCGM_FI_DEV_GPU_TEMP": 51.5})}
    plain = ingest.parse_exposition(lines.where("scrape_id = 's2'").select("line_no", "line")).collect()
    assert len(plain) == 1 and plain[0].time is None


def test_exposition_odd_label_texts(spark):
    text = [
        'm{UUID="G0",UUID="G1",gpu="2",} 1',            # last of equal keys, comma at the end
        'm{XUUID="x",UUID="G2"} 2\t1700000000000',      # a key that ends in the name; tab after the value
        'm{ UUID = "G3" , gpu = "4",modelName="A B"} 3',
        "m{UUID=G4} 4",
        'm{UUID="G5"gpu="1"} 5',                        # no comma: one value
        'm{UUID="G6",UUID} 6',                          # the last UUID has no value
        'm{UUID="a{b"} 7',
        'm{UUID="G8",modelName="x,y"} 8',
        'm{UUID="G9"',
        '# m{UUID="G10"} 10',
        "m{" + ",".join(f'k{i}="v"' for i in range(5000)) + ',UUID="G11"} 11',
    ]
    lines = spark.createDataFrame([("s", dt.datetime(2024, 1, 1), i, x) for i, x in enumerate(text)],
                                  "scrape_id string, scraped_at timestamp, line_no long, line string")
    got = {r.gpu_uuid: (r.device_index, r.model, r.metrics["m"]) for r in ingest.parse_exposition(lines).collect()}
    assert got == {"G1": (2, None, 1.0), "G2": (0, None, 2.0), "G3": (4, "A B", 3.0), "G4": (0, None, 4.0),
                   'G5"gpu="1': (0, None, 5.0), "a{b": (0, None, 7.0), "G8": (0, "x", 8.0), "G11": (0, None, 11.0)}


def test_exposition_lines_are_cut_once(spark):
    """No filter cuts the labels or the value of a line again."""
    m = spark.createDataFrame([("s", dt.datetime(2024, 1, 1), 1, 'm{UUID="G"} 1')],
                              "scrape_id string, scraped_at timestamp, line_no long, line string")
    plan = ingest.parse_exposition(m)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Filter" in x and ("str_to_map" in x or "split(" in x or "regexp" in x)]


def test_valid_events_are_parsed_once(spark):
    """Each field of the stamped event would parse the JSON text again."""
    checked = validate.validate(spark.createDataFrame([(event(),)], "value string"), now=F.lit(NOW))
    plan = validate.valid_events(checked.select("value", "is_valid"), now=F.lit(NOW))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(schema_version,StringType,true), StructField(event_type,StringType,true), "
                      "StructField(timestamp,StringType,true), StructField(collection_timestamp") == 1


def test_error_breakdown_validates_once(spark):
    raw = spark.createDataFrame([(event(),), (event(timestamp="x"),), ("{",)], "value string")
    out = validate.error_breakdown(validate.validate(raw, now=F.lit(NOW)))
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    assert [tuple(r) for r in out.collect()] == [
        ("__invalid__", 2, 66.7), ("__valid__", 1, 33.3), ("Invalid JSON", 1, None), ("Invalid timestamp format", 1, None)]


def test_typed_view_passes_only_events_without_errors(spark):
    plain = [event(), event(**{"metrics.performance.pcie_tx_mb_per_sec": 900.0}), event(**{"metrics.clocks.sm_clock_mhz": 0})]
    odd = [event(**{"metrics.performance.sm_active_pct": v}) for v in ("150", None, {}, True, 100.5)]
    odd += [event(**{k: v}) for k, v in (("metrics.health.gpu_temp_c", None), ("metrics.health.gpu_temp_c", "121"), ("host", 5),
            ("gpu.gpu_uuid", ""), ("schema_version", None), ("metrics.memory", []), ("metrics.performance.x_active", -1))]
    odd += [event(host=KeyError), event(**{"metrics.health.power_usage_w": KeyError}), "[]", "{not json", None]
    df = spark.createDataFrame([(t,) for t in plain + odd], "value string")
    ok = df.select(validate.passes(F.from_json("value", validate.CHECKED_FIELDS)).alias("ok")).collect()
    assert [r.ok for r in ok] == [True] * len(plain) + [False] * len(odd)
    assert errors_of(spark, plain) == [[], [], []]
    # twice the same key is no valid JSON, though the typed view takes the last one
    twice = event().replace('"gpu_temp_c"', '"gpu_temp_c": 200, "gpu_temp_c"')
    assert errors_of(spark, [twice, odd[0], odd[1]]) == [
        ["Invalid JSON"], ["sm_active_pct out of range: 150.0% (expected 0-100)"], []]

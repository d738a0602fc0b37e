"""op4 against SQL; files are reproducible and readable; edge cases."""

import gzip

from fleetscope.llm.common import file_system
from fleetscope.llm.warc_writer import archive, read_archive
from oracle import same_as_sql


def test_matches_sql(spark):
    same_as_sql(spark, "op4_warc_writer", "/root/testdata/sf0.01")


def test_files_are_reproducible_and_edge_cases(spark):
    body = "<p>" + "same payload " * 20 + "</p>"
    rows = [(i, f"http://x/{i}\r\nEvil: 1", f"<html>{i}</html>" * (i % 50), i) for i in range(200)] + [
        (i, f"http://copy/{i}", body, i) for i in range(300, 200, -1)] + [
        (400, None, None, 0), (401, "", "", 0), (402, "http://long", "ü" * 500_000, 0), (403, "http://a", "short", 0), (404, "http://a", "short", 0),
        (405, "http://b", body[:-1], 0), (405, "http://b", body[:-1], 0), (None, "http://n", "null id " * 30, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    made = [archive(p, shard_bytes=20_000, roll_bytes=4_000) for p in (pages, pages.repartition(6))]
    kept = [sorted((r.file, r.records, r.sha256) for r in m.collect()) for _, m in made]
    assert kept[0] == kept[1] and len({k[0][:11] for k in kept[0]}) > 3 and len(kept[0]) > len({k[0][:11] for k in kept[0]})
    got = read_archive(spark, made[0][0]).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert all(r.record_type == "revisit" and r.refers_to == 201 for i in range(202, 301) for r in by[i])
    assert by[201][0].record_type == "response" and bytes(by[201][0].payload).decode() == body
    assert bytes(by[402][0].payload).decode() == "ü" * 500_000 and by[400][0].payload_bytes == 0 and by[400][0].url == "urn:page:400"
    assert [by[i][0].record_type for i in (403, 404)] == ["response"] * 2
    assert sorted((r.record_type, r.refers_to) for r in by[405]) == [("response", None), ("revisit", 405)]
    assert by[None][0].record_type == "response"
    filesystem, base = file_system(made[0][0])
    with filesystem.open_input_stream(f"{base}/{kept[0][0][0]}", compression=None) as f:
        text = gzip.decompress(f.read()).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: ") and "\r\nEvil: 1" not in text
    root, manifest = archive(pages.limit(0))
    assert manifest.count() == 0 and read_archive(spark, root).count() == 0

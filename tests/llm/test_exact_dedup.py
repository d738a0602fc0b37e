"""op7 against SQL; Misra-Gries; edge cases."""

import random
from collections import Counter

from fleetscope.llm.exact_dedup import exact_dedup, frequent_digests, keep_rows, shrink
from oracle import same_as_sql

SF = "/root/testdata/sf0.01"


def test_matches_sql(spark):
    same_as_sql(spark, "op7_exact_dedup", SF)


def test_frequent_digests_are_all_found(spark):
    rng = random.Random(4)
    values = [f"hot{i}" for i in range(5) for _ in range(300)] + [f"cold{i}" for i in range(4000)]
    rng.shuffle(values)
    df = spark.createDataFrame([(v.encode(),) for v in values], "digest binary").repartition(9)
    found = {bytes(r.digest) for r in frequent_digests(df, share=0.02, counters=60).collect()}
    assert {f"hot{i}".encode() for i in range(5)} <= found
    assert len(found) <= 1 / (0.02 - 1 / 61)
    assert shrink(Counter("aaaabbbccd"), 2) == {"a": 2, "b": 1}


def test_edge_cases(spark):
    rows = [(i, "copy of\ta hot text", 0) for i in range(500, 0, -1)] + [(1000, "copy of a  hot text", 1), (2000, None, 2), (2001, "", 2), (2002, "\x0b \n", 2),
            (3000, "x" * 200_000, 3), (3000, "x" * 200_000, 3), (None, "no id", 4), (4000, "no id", 4), (None, "only null id", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = [(r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, share=0.05, counters=100).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g for g in got if g[0] is not None}
    assert by[7] == (7, 1000, 501, False) and by[1000] == (1000, 1000, 501, True)
    assert [by[i][1] for i in (2000, 2001, 2002)] == [2002] * 3 and by[3000] == (3000, 3000, 2, True)
    assert sorted((g[1] or -1, g[3]) for g in got if g[0] is None) == [(-1, True), (4000, False)]
    kept = keep_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 1000, 2002, 3000, 4000]
    assert exact_dedup(docs.limit(0)).count() == 0 and keep_rows(docs.limit(0)).count() == 0

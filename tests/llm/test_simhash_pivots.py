"""op8 against brute force; edge cases; bucket splitting."""

import numpy as np
import pandas as pd
import xxhash

from fleetscope.llm.components import components
from fleetscope.llm.simhash_pivots import fingerprint_links, keep_rows, simhash_components

SF = "/root/testdata/sf0.001"


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, k=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= k:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    best = {}
    for i in range(len(ids)):
        r = find(i)
        best[r] = min(best.get(r, ids[i]), ids[i])
    return {ids[i]: best[find(i)] for i in range(len(ids))}


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.id: (r.fp % (1 << 64), r.component_id) for r in simhash_components(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    ids, fps = [r.doc_id for r in rows], [brute_fp(r.text) for r in rows]
    want = brute_components(ids, fps)
    assert got == {i: (f, want[i]) for i, f in zip(ids, fps)}


def test_dense_buckets_are_split_exactly(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    noise = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(900)], np.uint64)
    fps = np.unique(base[rng.integers(0, 3, 900)] ^ noise)
    df = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    want = brute_components(fps.view(np.int64).tolist(), [int(x) for x in fps])
    for bucket_rows in (16_384, 64, 20):
        got = {r.node: r.root for r in components(fingerprint_links(df, 2, bucket_rows)).collect()}
        assert {k: got.get(k, k) for k in want} == want


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "One two", 0), (5, "one  TWO", 0), (6, "a b c d " * 5000, 0),
            (6, "a b c d " * 5000, 0), (None, "lonely words in a row here", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {r.id: (r.fp, r.component_id) for r in simhash_components(docs).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == [0, 0, 0] and {got[i][1] for i in (1, 2, 3)} == {1}
    assert got[4] == got[5] and got[5][1] == 4 and got[None][1] is None
    kept = keep_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 6]
    assert simhash_components(docs.limit(0)).count() == 0

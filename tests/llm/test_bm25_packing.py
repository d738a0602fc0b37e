"""op10: exact cover of every document's ids, BM25 against brute force, edge cases."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fleetscope.llm.bm25_packing import ShardIndex, pack, pack_shard
from fleetscope.llm.q_bm25_packing import op10_bm25_packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_cover(rows, docs, window=2048):
    t = Tokenizer.from_file(PATH)
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(want[i])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(len(v) for v in want.values()), len(by_seq)


def test_whole_table_is_covered_once(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    tokens, sequences = check_cover(op10_bm25_packing(spark, SF).collect(), docs)
    assert sequences <= -(-tokens // 2048) + 1


def test_many_shards_and_edge_cases(spark):
    rows = [(i, f"alpha beta gamma{i % 7} " * (i % 40), i) for i in range(300)] + [
        (1000, None, 0), (1001, "", 0), (1002, "long text here " * 20000, 0), (1003, "<|endoftext|> 日本  x\n\n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    got = pack(docs, PATH, window=128, shard_tokens=9000)
    tokens, sequences = check_cover(got.collect(), [(i, t) for i, t, _ in rows], 128)
    assert sequences <= -(-tokens // 128) + -(-tokens // 9000)
    again = sorted(map(tuple, pack(docs.repartition(5), PATH, window=128, shard_tokens=9000).collect()))
    assert sorted(map(tuple, got.collect())) == again
    assert pack(docs.limit(0), PATH).count() == 0


def test_neighbours_rank_by_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.zipf(1.4, rng.integers(5, 80)) % 500 for _ in range(120)]
    df = Counter(t for d in docs for t in set(d.tolist()))
    idf = np.zeros(500, np.float32)
    for t, n in df.items():
        idf[t] = math.log1p((len(docs) - n + 0.5) / (n + 0.5))
    mean = float(np.mean([len(d) for d in docs]))
    index = ShardIndex(docs, idf, mean)
    unused = rng.random(120) < 0.7
    for seed in range(20):
        q = index.query(seed, 12)
        want = {}
        for i, d in enumerate(docs):
            tf = Counter(d.tolist())
            s = sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in q.tolist() if t in tf)
            if s > 0 and unused[i]:
                want[i] = s
        got = index.neighbours(seed, unused, 12).tolist()
        assert set(got) == set(want)
        assert all(want[a] >= want[b] - 1e-4 for a, b in zip(got, got[1:]))


def test_windows_hold_neighbours():
    docs = [np.array([k % 5 * 10 + j for j in range(10)] * 3) for k in range(50)]
    index = ShardIndex(docs, np.ones(60, np.float32), 30.0)
    mixed = 0
    for seq in pack_shard([len(d) for d in docs], index, 100, 8):
        mixed += len({i % 5 for i, _, _ in seq}) > 1
    assert mixed <= 5

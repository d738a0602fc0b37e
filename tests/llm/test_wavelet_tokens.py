"""op6: exact round trip, rank/select against brute force, edge cases."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fleetscope.llm.bpe import load
from fleetscope.llm.q_wavelet_tokens import op6_wavelet_tokens
from fleetscope.llm.wavelet_tokens import WaveletMatrix, dump, open_shard, parse, read_tokens, token_files

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  a  b ", "it's I'LL don't 'S", "<|endoftext|> hi", "²³ ½ 12a", "ÀÉ İstanbul ǅ ß ſ", "日本語 text", "a\x00b", "\x1c x \x85 y \xa0 z",
       "é é", "… “q” €5 –—", "Σίσυφος ΣΑΣ", "\t\t a\r\n b", "ª º µ × ÷ ¿", "\n\n x   y"]


def expect(docs):
    t = Tokenizer.from_file(PATH)
    out, start = {}, 0
    for i, text in sorted(docs):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_whole_table_round_trip(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op6_wavelet_tokens(spark, SF).collect()}
    assert got == expect(docs)


def test_fast_ids_equal_the_library():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        bpe = load(public_tokenizers.path(name))
        assert bpe.fast is not None
        for text, ids in zip(ODD, bpe.encode(ODD)):
            assert ids.tolist() == bpe.slow.encode(text, add_special_tokens=False).ids, (name, text)


def test_access_rank_select():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 511, 513, 3000):
        ids = rng.choice([0, 1, 5, 6, 200, 1023], n).astype(np.uint32)
        m, names, starts = parse(dump(ids, [1], [0], 10))
        assert (m.decode() == ids).all() and names == [1] and starts == [0]
        for i in rng.integers(0, n, min(n, 40)) if n else []:
            v = int(ids[i])
            assert m.access(int(i)) == v
            assert m.rank(v, int(i)) == int((ids[:i] == v).sum())
            assert m.count(v, int(i)) == int((ids[i:] == v).sum())
            where = np.flatnonzero(ids == v)
            k = int(rng.integers(0, len(where)))
            assert m.select(v, k) == where[k] and m.select(v, len(where)) == -1
        assert m.count(7) == 0 and m.count(5000) == 0
    assert WaveletMatrix.build(np.array([70000]), 17).decode().tolist() == [70000]


def test_shards_files_and_edge_cases(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(100, None, 0), (101, "word " * 30000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    sets = [token_files(d, PATH, shard_chars=200, roll_tokens=64) for d in (docs, docs.repartition(7))]
    kept = [sorted((r.file, r.sha256) for r in m.collect()) for _, m in sets]
    assert kept[0] == kept[1] and len(kept[0]) >= 3
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_tokens(spark, sets[0][0]).collect()}
    assert got == expect([(i, t) for i, t, _ in rows])
    m, names, _ = open_shard(sets[0][0], kept[0][-1][0])
    assert names[-1] == 101 and m.count(2) == len(names)
    root, manifest = token_files(docs.limit(0), PATH)
    assert manifest.count() == 0 and read_tokens(spark, root, with_ids=True).count() == 0

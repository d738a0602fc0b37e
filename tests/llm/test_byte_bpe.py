"""op12 against the tiktoken library, against a plain merge loop, and there and back."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscope.llm import byte_bpe
from fleetscope.llm.byte_bpe import ByteBpe, PairRanks, decode_table, encode_table, load_ranks, merge_many, merge_piece
from fleetscope.llm.q_byte_bpe import op12_byte_bpe

SF = "/root/testdata/sf0.01"
PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def sha256(data):
    return hashlib.sha256(data).hexdigest()


def test_whole_table_against_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in op12_byte_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha256(np.array(ids, "<u4").tobytes()), sha256((d.text or "").encode()))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_against_the_library(text):
    bpe = load_ranks(PATH, P.PATTERN)
    [ids] = bpe.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def plain_merges(piece, ranks):
    """The definition: merge the leftmost pair of lowest rank until no pair has one."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_segment_tree_against_the_definition():
    rng = random.Random(5)
    for _ in range(300):  # few symbols and a small random vocabulary: many ties, chains and dead ends
        ranks = {bytes([b]): b for b in range(256)}
        for _ in range(rng.randrange(40)):
            a, b = rng.choice(list(ranks)[-40:]), rng.choice(list(ranks)[-40:])
            a, b = (x if x[0] < 100 or rng.random() < 0.1 else b"a" for x in (a, b))
            ranks.setdefault(a + b, len(ranks))
        for word in (b"ab", b"aa", b"aab"):
            ranks.setdefault(word, len(ranks))
        for n in (1, 2, 3, 7, 8, 9, 40):
            piece = bytes(rng.choice(b"aab") for _ in range(n))
            assert merge_piece(piece, ranks) == plain_merges(piece, ranks)
        single, pairs = np.arange(256), PairRanks(ranks)
        for shift, longest in ((1, 2), (2, 4), (5, 32)):
            pieces = [p for p in (bytes(rng.choice(b"aab") for _ in range(rng.randrange(2, longest + 1))) for _ in range(30)) if p not in ranks]
            got = [np.frombuffer(x, "<u4").tolist() for x in merge_many(pieces, shift, single, pairs)]
            assert got == [plain_merges(p, ranks) for p in pieces]


def test_long_pieces_and_every_byte():
    rng = random.Random(6)
    bpe = load_ranks(PATH, P.PATTERN)
    for text in ("a" * 50_000, " " * 30_001 + "x", "".join(rng.choice("abcdeACGT") for _ in range(40_000)), "".join(map(chr, range(1, 0x3000))), "\U0001f600" * 2000):
        [ids] = bpe.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text) and bpe.decode(ids) == text.encode()
    with pytest.raises(ValueError):
        ByteBpe({b"a": 0}, P.PATTERN)


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED", 20)
    bpe = ByteBpe(RANKS, P.PATTERN)
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcäö") for _ in range(rng.randrange(1, 9))) for _ in range(40)) for _ in range(30)]
    got = [x for part in byte_bpe.in_portions(texts, 500) for x in bpe.encode(part)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [LIBRARY.encode_ordinary(t) for t in texts] and len(bpe.older) < 300


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "twice", 0), (3, "twice", 0), (None, "no id", 1), (4, " \n\t ", 1), (5, "w " * 200_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = encode_table(docs, PATH, P.PATTERN)
    got = sorted(((r.id, bytes(r.decoded), r.n_tokens, len(r.ids)) for r in decode_table(encoded, PATH, P.PATTERN).collect()), key=repr)
    assert got == sorted(((i, (t or "").encode(), len(x), 4 * len(x)) for i, t, _ in rows for x in [LIBRARY.encode_ordinary(t or "")]), key=repr)
    assert decode_table(encode_table(docs.limit(0), PATH, P.PATTERN), PATH, P.PATTERN).count() == 0

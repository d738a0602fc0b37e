"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut by a split pattern; each piece is merged separately. A piece that is a
vocabulary entry is that token. Otherwise every byte starts as a part of its own, and the
leaves of a segment tree over the byte positions hold the rank of the pair that starts
there: of the live part at the position and its live right neighbour. Inner nodes keep the
leftmost minimum, so the root names the next merge. A merge joins two neighbouring parts,
kills the right one's position and changes at most three leaves: its own, its left
neighbour's and the dead one's, each a walk from leaf to root. A piece of ``n`` bytes
takes O(n log n) steps, whatever its shape. The walks are done together, level by level. Short pieces
are merged many at a time: a row of one array is one piece's tree, and all rows take a step.

Decoding looks up each id's bytes and joins them.

Each process remembers the ids of pieces met lately, up to about twice ``CACHED``; the others
are merged anew, which changes no result.

Edge cases: null and empty texts have no ids; a text of any length is encoded whole, piece
by piece, by the task that holds its row; repeated rows are encoded each; an empty table
gives an empty result; null ids are carried; other columns are not read. Unknown ids raise
``KeyError`` in decoding; a vocabulary without all 256 single bytes is refused.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import small_batches

#: Different pieces of a generation that a process remembers, and the longest of them in characters.
CACHED, CACHED_CHARS = 200_000, 64
#: Longest pieces, in bytes, that are merged in step with others; characters of the texts that are encoded at once.
TOGETHER, PORTION = 64, 1 << 20
#: Above every rank: no pair starts here.
NONE = 1 << 62


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece by repeated merges of the leftmost pair of lowest rank."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return [ranks[piece]] if n else []
    shift = (n - 1).bit_length()
    base = 1 << shift
    # a node holds rank << shift | position: the smaller one is the lower rank, then the further left
    tree = [NONE] * (2 * base)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that starts at a position
    find = ranks.get
    for i in range(n - 1):
        rank = find(piece[i:i + 2])
        if rank is not None:
            tree[base + i] = rank << shift | i
    for node in range(base - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    while (best := tree[1]) != NONE:
        i = best & base - 1
        dead, previous = end[i], before[i]
        stop = end[i] = end[dead]
        before[stop] = i
        tree[base + dead] = NONE
        rank = find(piece[i:end[stop]]) if stop < n else None
        tree[base + i] = NONE if rank is None else rank << shift | i
        if previous >= 0:
            rank = find(piece[previous:stop])
            tree[base + previous] = NONE if rank is None else rank << shift | previous
        # the walks of the changed leaves to the root, level by level; they soon meet
        a, b, c = base + previous >> 1 if previous >= 0 else base + i >> 1, base + i >> 1, base + dead >> 1
        while a:
            left, right = tree[2 * a], tree[2 * a + 1]
            tree[a] = left if left < right else right
            if b != a:
                left, right = tree[2 * b], tree[2 * b + 1]
                tree[b] = left if left < right else right
            if c != b:
                left, right = tree[2 * c], tree[2 * c + 1]
                tree[c] = left if left < right else right
            a, b, c = a >> 1, b >> 1, c >> 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class PairRanks:
    """Rank of the token that two neighbouring tokens make, for arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values()) + 1
        made = sorted((ranks[t[:k]] * self.width + ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.keys, self.made = (np.array(c, np.int64) for c in zip(*made)) if made else (np.full(1, -1, np.int64),) * 2

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged token's id, -1 where the pair makes none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)


def merge_many(pieces: list[bytes], shift: int, single: np.ndarray, pairs: PairRanks) -> list[bytes]:
    """``merge_piece`` of many pieces of at most ``1 << shift`` bytes, one segment tree a row, all rows in step.

    Returns each piece's ids as little-endian unsigned 32-bit integers.
    """
    base, m = 1 << shift, len(pieces)
    n = np.fromiter(map(len, pieces), np.int64, m)
    ids = single[np.frombuffer(b"".join([p.ljust(base, b"\0") for p in pieces]), np.uint8).reshape(m, base)]
    place = np.arange(base)
    alive = place < n[:, None]
    end, before = np.tile(np.arange(1, base + 2), (m, 1)), np.tile(np.arange(-1, base), (m, 1))
    key = lambda rank, i: np.where(rank >= 0, rank << shift | i, NONE)
    tree = np.full((m, 2 * base), NONE)
    tree[:, base:-1] = np.where(alive[:, 1:], key(pairs(ids[:, :-1], ids[:, 1:]), place[:-1]), NONE)
    for h in [1 << k for k in reversed(range(shift))]:
        tree[:, h:2 * h] = np.minimum(tree[:, 2 * h:4 * h:2], tree[:, 2 * h + 1:4 * h:2])
    row = np.flatnonzero(tree[:, 1] != NONE)
    while len(row):
        best = tree[row, 1]
        i, merged = best & base - 1, best >> shift
        dead, previous = end[row, i], before[row, i]
        stop = end[row, dead]
        end[row, i], before[row, stop], ids[row, i], alive[row, dead] = stop, i, merged, False
        tree[row, base + dead] = NONE
        tree[row, base + i] = np.where(stop < n[row], key(pairs(merged, ids[row, np.minimum(stop, base - 1)]), i), NONE)
        has = np.flatnonzero(previous >= 0)
        tree[row[has], base + previous[has]] = key(pairs(ids[row[has], previous[has]], merged[has]), previous[has])
        walks = [base + np.where(previous >= 0, previous, i), base + i, base + dead]
        for _ in range(shift):
            walks = [w >> 1 for w in walks]
            for w in walks:
                tree[row, w] = np.minimum(tree[row, 2 * w], tree[row, 2 * w + 1])
        row = row[tree[row, 1] != NONE]
    out = ids[alive].astype("<u4").tobytes()
    cut = np.concatenate([[0], np.cumsum(alive.sum(1) * 4)]).tolist()
    return [out[a:z] for a, z in zip(cut, cut[1:])]


class ByteBpe:
    """Encoder and decoder of one vocabulary of ranks (token bytes -> id) and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks, self.bytes_of = ranks, {i: t for t, i in ranks.items()}
        self.single, self.pairs = np.array([ranks[bytes([b])] for b in range(256)], np.int64), PairRanks(ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids_of(self, pieces: set[str]) -> dict[str, bytes]:
        """Each piece's ids as little-endian unsigned 32-bit integers."""
        found, waiting = {}, {}
        for piece in pieces:
            data = piece.encode()
            if data in self.ranks or len(data) > TOGETHER:
                ids = merge_piece(data, self.ranks)
                found[piece] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                waiting.setdefault((len(data) - 1).bit_length(), []).append((piece, data))
        for shift, group in waiting.items():
            found.update(zip([p for p, _ in group], merge_many([d for _, d in group], shift, self.single, self.pairs)))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """All ids of each text as little-endian unsigned 32-bit integers.

        The more texts at once, the more pieces are merged in step; pieces met lately are remembered.
        """
        split = [self.split(t) if t else [] for t in texts]
        known, older = self.known, self.older
        now = {p: known.get(p) or older.get(p) for p in set().union(*split)}
        now.update(self._ids_of({p for p, ids in now.items() if ids is None}))
        known.update((p, ids) for p, ids in now.items() if len(p) <= CACHED_CHARS)
        if len(known) >= CACHED:
            self.known, self.older = {}, known
        return [b"".join([now[p] for p in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        """The text's bytes from its ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def in_portions(texts: list[str | None], chars: int = PORTION) -> Iterator[list[str | None]]:
    """``texts`` in runs of about ``chars`` characters, a longer text alone."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


@lru_cache(maxsize=4)
def load_ranks(path: str, pattern: str) -> ByteBpe:
    """One encoder for each rank file (base64 token and id a line), pattern and process."""
    with open(path, "rb") as f:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def encode_table(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and ids (binary, little-endian unsigned 32-bit) of each document."""
    small_batches(docs.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_ranks(ranks, pattern)
        for b in batches:
            found = [ids for part in in_portions(b.column(1).to_pylist()) for ids in bpe.encode(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())], ["id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long, ids binary")


def decode_table(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded`` (id, n_tokens, ids) with ``decoded``, the bytes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_ranks(ranks, pattern)
        for b in batches:
            texts = [bpe.decode(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    return encoded.select("id", "n_tokens", "ids").mapInArrow(run, "id long, n_tokens long, ids binary, decoded binary")

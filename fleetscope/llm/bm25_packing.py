"""Lexical retrieval packing.

Documents become token sequences (ids plus an end id) and are dealt into shards by the
hash of their id, so that a shard's documents fit in a task. Every shard has its own
BM25 inverted index over token ids, built from the whole documents, with document
frequencies and mean length of the whole corpus. Full windows of a long document
stand alone. What remains of each document is packed: the next unused document seeds
a window, the index returns its unused neighbours by BM25 score of the seed's
``query_terms`` heaviest terms, and they fill the window greedily; the one that
overflows is cut and its rest stays unused, to be retrieved or seed later. When the
index has no unused neighbour left, unused documents follow in order of id. So every
window but a shard's last one is full.

Edge cases: null and empty texts hold only the end id; null ids are hashed and ordered
like any other (last); equal scores go to the smaller id; rows that repeat an id are
documents of their own; an empty table gives an empty result. A text of any length is
read whole, by one task, as one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.bpe import load
from fleetscope.llm.common import shared_path, small_batches

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seed boolean")
#: Sequences of a shard are numbered from shard * SEQUENCES.
SEQUENCES = 1 << 32


def _tokenise(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        kind = np.dtype("<u2") if max(bpe.size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        found = np.zeros(max(bpe.size, end_id + 1), np.int64)
        rows = total = 0

        def batch(ids, data, n, df):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary()), pa.array(n, pa.int64()),
                                               pa.array(df, pa.binary())], ["id", "tokens", "n", "df"])

        for b in batches:
            data, sizes = [], []
            for tokens in bpe.encode(b.column(1).to_pylist()):
                found[np.unique(tokens)] += 1
                data.append(np.append(tokens, end_id).astype(kind).tobytes())
                sizes.append(len(tokens) + 1)
            rows, total = rows + len(sizes), total + sum(sizes)
            yield batch(b.column(0).to_pylist(), data, sizes, [None] * len(sizes))
        if rows:  # one row of sums per task; its n is negative: - documents
            yield batch([total], [None], [-rows], [found.tobytes()])
    return run


def corpus_statistics(table: DataFrame) -> tuple[int, int, np.ndarray]:
    """(documents, tokens, document frequency per token id) over all tasks' sums.

    Each task's sums are a vector as long as the vocabulary; they are added up by
    token id in a shuffle, and the driver receives one vector.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for b in batches:
            for df in b.column(0).to_pylist():
                v = np.frombuffer(df, np.int64)
                total = v.copy() if total is None else total + v
        if total is not None:
            token = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(total[token])], ["token", "n"])

    sums = table.where("n < 0")
    docs, tokens = sums.agg(F.coalesce(-F.sum("n"), F.lit(0)), F.coalesce(F.sum("id"), F.lit(0))).first()
    got = sums.select("df").mapInArrow(spread, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    token, n = got.column("token").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(int(token.max()) + 1 if len(token) else 1, np.int64)
    df[token] = n
    return docs, tokens, df


class ShardIndex:
    """BM25 postings of one shard: documents and weights by term."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        terms, owner, tf = [], [], []
        for i, tokens in enumerate(docs):
            t, n = np.unique(tokens, return_counts=True)
            terms.append(t)
            tf.append(n)
            owner.append(np.full(len(t), i, np.int32))
        term = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        who, n = (np.concatenate(x) if x else np.zeros(0) for x in (owner, tf))
        size = np.array([len(d) for d in docs], float)
        norm = k1 * (1 - b + b * size / max(mean, 1e-9))
        weight = (idf[term] * n * (k1 + 1) / (n + norm[who])).astype(np.float32) if len(term) else np.zeros(0, np.float32)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = who[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        self.term, self.own = term, weight
        self.n = len(docs)

    def query(self, doc: int, terms: int) -> np.ndarray:
        """The heaviest terms of a document that another document of the shard holds too."""
        a, z = self.first[doc], self.first[doc + 1]
        t, w = self.term[a:z], self.own[a:z]
        t, w = (x[self.at[t.astype(np.int64) + 1] - self.at[t] > 1] for x in (t, w))
        return t[np.lexsort((t, -w))[:terms]]

    def neighbours(self, doc: int, unused: np.ndarray, terms: int) -> np.ndarray:
        """Unused documents that share a query term, best score first, ties by position."""
        q = self.query(doc, terms)
        if not len(q):
            return q
        parts = [slice(self.at[t], self.at[t + 1]) for t in q.tolist()]
        who = np.concatenate([self.doc[p] for p in parts])
        score = np.bincount(who, np.concatenate([self.weight[p] for p in parts]), self.n)
        near = np.flatnonzero((score > 0) & unused)
        return near[np.argsort(-score[near], kind="stable")]


def pack_shard(sizes: list[int], index: ShardIndex, window: int, terms: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); the first piece is the seed's."""
    start = np.zeros(len(sizes), np.int64)
    for i, n in enumerate(sizes):
        while n - start[i] >= window:
            yield [(i, int(start[i]), window)]
            start[i] += window
    rest = np.array(sizes, np.int64) - start
    unused = rest > 0
    lead = 0
    while True:
        while lead < len(sizes) and not unused[lead]:
            lead += 1
        if lead == len(sizes):
            return
        room, seq = window, []

        def take(i: int) -> None:
            nonlocal room
            n = int(min(room, rest[i]))
            seq.append((i, int(start[i]), n))
            start[i] += n
            rest[i] -= n
            room -= n
            unused[i] = rest[i] > 0

        take(lead)
        for i in index.neighbours(lead, unused, terms).tolist():
            if not room:
                break
            take(i)
        i = lead
        while room and i < len(sizes):  # the index is exhausted: documents in order
            if unused[i]:
                take(i)
            i += 1
        yield seq


def _packer(window: int, terms: int, idf: np.ndarray, mean: float, wide: bool):
    kind = np.dtype("<u4") if wide else np.dtype("<u2")
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, docs = None, [], []

        def packed() -> Iterator[pa.RecordBatch]:
            index = ShardIndex([d[:-1] for d in docs], idf, mean)
            rows = []
            for k, seq in enumerate(pack_shard([len(d) for d in docs], index, window, terms)):
                offset = 0
                for j, (i, start, n) in enumerate(seq):
                    crc = zlib.crc32(docs[i][start:start + n].astype("<u4"))
                    rows.append((ids[i], start, n, crc, len(docs[i]), shard * SEQUENCES + k, offset, j == 0))
                    offset += n
            types = [pa.int64()] * 7 + [pa.bool_()]
            for at in range(0, len(rows), 20_000):
                part = list(zip(*rows[at:at + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types)], names)

        for b in batches:
            for s, i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if s != shard:
                    if docs:
                        yield from packed()
                    shard, ids, docs = s, [], []
                ids.append(i)
                docs.append(np.frombuffer(data.as_buffer(), kind).copy())
        if docs:
            yield from packed()
    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text",
         shard_tokens: int = 1 << 21, query_terms: int = 24) -> DataFrame:
    """One row per piece; see ``PIECES``. Sequences shorter than ``window`` are to be padded."""
    spark = docs.sparkSession
    small_batches(spark, 200)
    path = shared_path(spark, "packing-tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, tokens binary, n long, df binary"
    rows.mapInArrow(_tokenise(tokenizer, end_id), schema).write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    n_docs, n_tokens, df = corpus_statistics(table)
    idf = np.zeros(max(load(tokenizer).size, end_id + 1), np.float32)
    idf[:len(df)] = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    shards = max(1, -(-int(n_tokens) // shard_tokens))
    wide = len(idf) > 1 << 16
    dealt = table.where("n >= 0").select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "tokens")
    return (dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_last(), F.xxhash64("tokens"))
            .mapInArrow(_packer(window, query_terms, idf, n_tokens / max(1, n_docs), wide), PIECES))

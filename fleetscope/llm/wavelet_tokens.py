"""Token ids as one wavelet matrix per shard.

A shard is a range of ascending document ids. Its token ids form one sequence, each
document closed by an end id, stored as bit planes from the highest bit down; each
plane is in the order that the stable partitions by the planes above leave behind.
With a running count of ones per 512 bits this supports access to any token, the
count of a token in any range and the place of its k-th occurrence, all from the one
compressed file; ``decode`` undoes all partitions at once.

File: ``WVM1``, header length (4 bytes, little-endian), header as JSON (levels, number
of tokens, documents' ids and starts, zeros and compressed size per plane), then the
planes, each a Zstandard frame of packed bits. Shards are cut from the rows alone, so
equal tables give equal files. Files are written under temporary names and listed in
a manifest that Spark commits.

Edge cases: null and empty texts hold only the end id; null document ids sort last;
a text of any length lies in one file; rows that repeat an id are ordered by the hash
of their text; an empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.llm.bpe import load
from fleetscope.llm.common import commit_bytes, file_system, shard_bounds, shard_column, shared_path, small_batches

MAGIC = b"WVM1"
BLOCK = 512
MANIFEST = "shard int, seq int, file string, documents long, tokens long, bytes long, sha256 string"


class WaveletMatrix:
    """A sequence of integers below ``2 ** levels`` as bit planes."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.zeros, self.n, self.levels = planes, zeros, n, len(planes)
        self._ones: list[np.ndarray | None] = [None] * self.levels

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for k in reversed(range(levels)):
            bit = (now & now.dtype.type(1 << k)) != 0
            planes.append(np.packbits(bit))
            if not k:  # what the last partition would give is never read
                zeros.append(len(bit) - int(np.count_nonzero(bit)))
                break
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
            zeros.append(len(low))
            parted = np.empty_like(now)
            now.take(low, out=parted[:len(low)], mode="clip")
            now.take(high, out=parted[len(low):], mode="clip")
            now = parted
        return cls(planes, zeros, len(ids))

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        if self._ones[level] is None:
            per = np.add.reduceat(np.bitwise_count(self.planes[level]).astype(np.int64), np.arange(0, len(self.planes[level]), BLOCK // 8)) \
                if len(self.planes[level]) else np.zeros(0, np.int64)
            self._ones[level] = np.concatenate([[0], np.cumsum(per)])
        block = i // BLOCK
        part = self.planes[level][block * (BLOCK // 8):i >> 3]
        tail = int(self.planes[level][i >> 3]) >> (8 - (i & 7)) if i & 7 else 0
        return int(self._ones[level][block]) + int(np.bitwise_count(part).sum()) + tail.bit_count()

    def access(self, i: int) -> int:
        """The integer at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(self.levels):
            b, ones = self._bit(k, i), self._rank1(k, i)
            out = out << 1 | b
            i = self.zeros[k] + ones if b else i - ones
        return out

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before position ``i``."""
        start, end = self._range(value, 0, i)
        return end - start

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of ``value`` in [start, end)."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def _range(self, value: int, a: int, b: int) -> tuple[int, int]:
        if value >> self.levels:
            return 0, 0
        for k in range(self.levels):
            ones_a, ones_b = self._rank1(k, a), self._rank1(k, b)
            if value >> (self.levels - 1 - k) & 1:
                a, b = self.zeros[k] + ones_a, self.zeros[k] + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return a, b

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) ``bit`` of a plane, by bisection on rank."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, value: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``value``; -1 if there are fewer."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in reversed(range(self.levels)):
            bit = value >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """The whole sequence: the partitions undone from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.unpackbits(self.planes[-1], count=self.n).astype(kind)
        for k in reversed(range(self.levels - 1)):
            bit = np.unpackbits(self.planes[k], count=self.n).view(bool)
            out = np.empty_like(now)
            now[self.zeros[k]:] |= now.dtype.type(1 << (self.levels - 1 - k))
            out[np.flatnonzero(~bit)] = now[:self.zeros[k]]
            out[np.flatnonzero(bit)] = now[self.zeros[k]:]
            now = out
        return now.astype("<u4")


def dump(ids: np.ndarray, doc_ids: list, starts: list[int], levels: int, level: int = 3) -> bytes:
    """A shard's file."""
    m = WaveletMatrix.build(ids, levels)
    squeeze = zstandard.ZstdCompressor(level=level)
    frames = [squeeze.compress(p.tobytes()) for p in m.planes]
    head = json.dumps({"levels": levels, "n": m.n, "zeros": m.zeros, "sizes": [len(f) for f in frames],
                       "doc_ids": doc_ids, "starts": starts}, separators=(",", ":")).encode()
    head = zstandard.ZstdCompressor(level=level).compress(head)
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(frames)


def parse(data: bytes) -> tuple[WaveletMatrix, list, list[int]]:
    """(matrix, document ids, each document's first position) of a shard's file."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet token file")
    size = struct.unpack("<I", data[4:8])[0]
    open_frame = zstandard.ZstdDecompressor()
    head = json.loads(open_frame.decompress(data[8:8 + size]))
    at, planes = 8 + size, []
    for n in head["sizes"]:
        planes.append(np.frombuffer(open_frame.decompress(data[at:at + n]), np.uint8) if n else np.zeros(0, np.uint8))
        at += n
    return WaveletMatrix(planes, head["zeros"], head["n"]), head["doc_ids"], head["starts"]


def open_shard(root: str, name: str) -> tuple[WaveletMatrix, list, list[int]]:
    """Load one file of a written set for access, counting and lookup."""
    filesystem, base = file_system(root)
    with filesystem.open_input_stream(f"{base}/{name}", compression=None) as f:
        return parse(f.read())


def _writer(root: str, tokenizer: str, end_id: int, roll_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        levels = max(1, max(bpe.size - 1, end_id).bit_length())
        filesystem, base = file_system(root)
        end = np.array([end_id], np.uint32)
        shard, seq, held, parts, ids, starts, done = None, 0, 0, [], [], [], []
        waiting: list[tuple] = []  # (id, text) read but not encoded yet
        chars = 0

        def close():
            nonlocal seq, held, parts, ids, starts
            if ids:
                name = f"tokens-{shard:06d}-{seq:05d}.wvm"
                data = dump(np.concatenate(parts), ids, starts, levels)
                commit_bytes(filesystem, f"{base}/_tmp", f"{base}/{name}", data)
                done.append((shard, seq, name, len(ids), held, len(data), hashlib.sha256(data).hexdigest()))
                seq += 1
            held, parts, ids, starts = 0, [], [], []

        def take():
            nonlocal held, waiting, chars
            for (i, _), tokens in zip(waiting, bpe.encode([t for _, t in waiting])):
                ids.append(i)
                starts.append(held)
                parts.extend([tokens, end])
                held += len(tokens) + 1
                if held >= roll_tokens:
                    close()
            waiting, chars = [], 0

        for b in batches:
            for s, i, text in zip(*(c.to_pylist() for c in b.columns)):
                if s != shard:
                    take()
                    close()
                    shard, seq = s, 0
                waiting.append((i, text))
                chars += len(text or "")
                if chars >= 4 << 20:
                    take()
        take()
        close()
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)
    return run


def write_tokens(docs: DataFrame, root: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                 shard_chars: int = 4 << 20, roll_tokens: int = 1 << 22) -> DataFrame:
    """Write the documents' ids below ``root``; returns the committed manifest."""
    spark = docs.sparkSession
    small_batches(spark, 200)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bounds = shard_bounds(rows, "id", F.coalesce(F.octet_length("text"), F.lit(0)) + 16, shard_chars)
    filesystem, base = file_system(root)
    filesystem.create_dir(f"{base}/_tmp", recursive=True)
    dealt = rows.select(shard_column(F.col("id"), bounds).alias("shard"), "id", "text")
    (dealt.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_last(), F.xxhash64("text"))
     .mapInArrow(_writer(root, tokenizer, end_id, roll_tokens), MANIFEST).write.parquet(f"{root}/manifest"))
    filesystem.delete_dir(f"{base}/_tmp")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_tokens(spark: SparkSession, root: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (over all files), n_tokens, ids_crc32 and, if asked, ids."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    # one row per file: the running total is over the file list, not over documents
    before = F.sum("tokens").over(Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    n = max(1, manifest.count())
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                matrix, docs, starts = open_shard(root, name)
                ids = matrix.decode()
                ends = [*starts[1:], len(ids)]
                parts = [ids[a:z] for a, z in zip(starts, ends)]
                columns = [pa.array(docs, pa.int64()), pa.array([base + a for a in starts], pa.int64()),
                           pa.array([len(p) for p in parts], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([p.tolist() for p in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.repartition(n, "file").mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str, **options) -> tuple[str, DataFrame]:
    """Write to a fresh folder in the shared folder; (root, manifest)."""
    root = shared_path(docs.sparkSession, "tokens")
    return root, write_tokens(docs, root, tokenizer, **options)

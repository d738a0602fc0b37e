"""SimHash near-dedup with pivot distance tables.

Every text gets a 64-bit fingerprint. For two fingerprints x, y and a pivot p,
``|d(x, p) - d(y, p)| <= d(x, y)``, so a table of Hamming distances to many fixed
pivots rules out a pair as soon as one coordinate differs by more than ``max_bits``.

Finding pairs without comparing all: the bits are cut into ``max_bits + 2`` blocks;
fingerprints within ``max_bits`` agree on at least two of them. For each pair of
blocks (a view) the distances to 16 pivots *inside the view* form a coordinate
vector, equal for any two fingerprints that agree there. Rows meet on the hash of
that vector, so no linked pair is missed and every fingerprint makes a fixed number
of rows. In a bucket a search walks from row to row: the pivot table discards by
maximum coordinate difference, the XOR of the survivors decides, and each row is
reached once, so a bucket gives a spanning forest of its links, never all pairs. A
bucket of more than ``bucket_rows`` fingerprints is split again by the same rule over
the bits still free in it, which is exact at every depth.

Edge cases: null text is empty; texts without words have fingerprint zero and link
like any other; equal fingerprints are one node; null ids take part but only name a
component that has no other id; repeated rows each get a row; a text of any length is
hashed whole, in the task that holds the row; an empty table gives an empty result; further
columns are carried by ``keep_rows`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import small_batches, store
from fleetscope.llm.components import components

#: Seed of the shingle hash, fixed by the contract; seed of the pivots, any value.
SEED = 42
N_PIVOTS = 16


def pivots(n: int = N_PIVOTS) -> list[int]:
    """``n`` reference fingerprints: hashes of 0, 1, 2, ..."""
    return [xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words of the A-Z-lowered text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(length[:-1] + 1)])
    end = (start + length)[size - 1:]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(start.tolist(), end.tolist())], np.uint64)


def fingerprints(texts: list, size: int, chunk: int = 200_000) -> np.ndarray:
    """Fingerprint of each text: a bit is 1 if set in over half of the hashes."""
    out = np.zeros(len(texts), np.uint64)
    ids: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def flush():
        nonlocal ids, parts, held
        if ids:
            votes = np.stack([_votes(p, chunk) for p in parts]) if held > chunk else _many_votes(parts)
            n = np.array([len(p) for p in parts])
            bits = (2 * votes > n[:, None]).astype(np.uint8)
            out[ids] = np.packbits(bits, axis=1).view(">u8").ravel()
        ids, parts, held = [], [], 0

    for i, t in enumerate(texts):
        hashes = shingle_hashes(t, size)
        if len(hashes):
            if held + len(hashes) > chunk:
                flush()
            ids.append(i)
            parts.append(hashes)
            held += len(hashes)
    flush()
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)


def _votes(hashes: np.ndarray, chunk: int) -> np.ndarray:
    return sum(_bits(hashes[i:i + chunk]).sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), chunk))


def _many_votes(parts: list[np.ndarray]) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    return np.add.reduceat(_bits(np.concatenate(parts)), starts, axis=0, dtype=np.int64)


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series(fingerprints(s.tolist(), shingle).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def views(free: int, max_bits: int) -> list[tuple[int, int]]:
    """(bits fixed, bits left free) for each pair of the ``max_bits + 2`` blocks of ``free``."""
    bits = [i for i in range(64) if free >> i & 1]
    blocks = [sum(1 << i for i in part.tolist()) for part in np.array_split(np.array(bits), max_bits + 2)]
    return [(a | b, free & ~(a | b)) for a, b in combinations(blocks, 2)]


def _deal(rows: DataFrame, masks: list[int], max_bits: int) -> tuple[DataFrame, list[int]]:
    """Rows (fp, path, key) keyed within the views of each path's free bits."""
    table = [views(m, max_bits) for m in masks]
    width = len(table[0])
    fixed = F.array(*[F.lit(_signed(f)) for t in table for f, _ in t])
    each = rows.select("fp", "key", F.explode(F.sequence(F.col("path") * width, F.col("path") * width + width - 1)).alias("path"))
    each = each.withColumn("mask", F.element_at(fixed, (F.col("path") + 1).cast("int")))
    coords: list[Column] = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.col("mask"))) for p in pivots()]
    each = each.select("fp", "path", F.xxhash64("key", "path", *coords).alias("key"))
    return each, [left for t in table for _, left in t]


def spanning_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (as positions) that connect all rows connected within ``max_bits``."""
    table = np.bitwise_count(fps[:, None] ^ np.array(pivots(), np.uint64)[None, :]).astype(np.int8)
    left = np.arange(len(fps))
    links = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = left
            for c in range(table.shape[1]):  # discard by coordinate difference
                near = near[np.abs(table[near, c] - table[x, c]) <= max_bits]
                if not len(near):
                    break
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= max_bits]  # verify
            if len(near):
                links += [(x, int(y)) for y in near]
                queue += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return links


def _bucket_links(max_bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None

        def linked(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            cut = np.flatnonzero(np.diff(key)) + 1
            start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            two = start[end - start == 2]
            ok = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= max_bits
            a, b = [fp[two[ok]]], [fp[two[ok] + 1]]
            for s, e in zip(start[end - start > 2], end[end - start > 2]):
                group = fp[s:e]
                for i, j in spanning_links(group.view(np.uint64), max_bits):
                    a.append(group[i:i + 1])
                    b.append(group[j:j + 1])
            return pd.DataFrame({"u": np.concatenate(a), "v": np.concatenate(b)})

        for f in frames:
            f = f if carry is None else pd.concat([carry, f])
            key, fp = f["key"].to_numpy(), f["fp"].to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            carry = f.iloc[last:]
            if last:
                yield linked(key[:last], fp[:last])
        if carry is not None and len(carry):
            yield linked(carry["key"].to_numpy(), carry["fp"].to_numpy())
    return run


def fingerprint_links(fps: DataFrame, max_bits: int = 2, bucket_rows: int = 16_384) -> DataFrame:
    """(u, v) links that join exactly what links within ``max_bits`` join.

    ``fps``: distinct fingerprints in column fp.
    """
    rows = fps.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key"))
    masks, found = [(1 << 64) - 1], None
    while True:
        dealt, masks = _deal(rows, masks, max_bits)
        sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = store(dealt.join(sizes, "key"), "simhash-buckets")
        small = met.where(F.col("n") <= bucket_rows).select("key", "fp")
        parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        links = (small.repartition(parts, "key").sortWithinPartitions("key")
                 .mapInPandas(_bucket_links(max_bits), "u long, v long").distinct())
        found = links if found is None else found.unionByName(links)
        rows = met.where(F.col("n") > bucket_rows).select("fp", "path", "key")
        if rows.isEmpty():
            return found


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 2, bucket_rows: int = 16_384) -> DataFrame:
    """One row per row of ``docs``: id, fp, component_id (smallest id reachable)."""
    rows = store(fingerprint_rows(docs, id_col, text_col, shingle), "fingerprints")
    nodes = store(rows.groupBy("fp").agg(F.min("id").alias("id")), "fingerprint-nodes")
    links = store(fingerprint_links(nodes.select("fp"), max_bits, bucket_rows), "fingerprint-links")
    roots = components(links)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    by_fp = store(named.join(smallest, "root").select("fp", "component_id"), "fingerprint-components")
    return rows.join(by_fp, "fp").select("id", "fp", "component_id")


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each component, with all columns: that of its smallest id.

    Rows that repeat an id and a text count once; other texts under that id stay.
    """
    found = simhash_components(docs, id_col, text_col, shingle, max_bits)
    stay = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["__id"]), "left_semi").dropDuplicates([id_col, text_col])

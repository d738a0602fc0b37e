"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``. One scan stores (id, digest, length) rows. Misra-Gries
summaries of the partitions, added up per digest, name every digest that may hold
more than ``share`` of the rows. Those few are counted exactly (partial sums
before the shuffle, a row per digest and task), and their winners are broadcast,
so that the copies of a hot text never meet in one task. The remaining digests
take an ordinary shuffle.

Edge cases: null text counts as empty; empty texts equal each other; of equal
lengths the smallest id stays, null ids last; rows that repeat an id with an equal
text share one verdict, and ``keep_rows`` returns one of them; an empty table gives
an empty result; a text of any length is hashed whole, in the task that holds the row;
further columns are carried by ``keep_rows`` only and may have any name but ``__id`` and
``__digest``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import id_key, store

#: Fixed by the contract: the characters that do not count.
BLANKS = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """32-byte SHA-256 of the text without blanks."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")
    return F.unhex(F.sha2(bare.cast("binary"), 256))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"))


def shrink(counts: dict, counters: int) -> dict:
    """Misra-Gries step: subtract the (counters + 1)-th largest count from all."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {d: n - cut for d, n in counts.items() if n > cut}


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for b in batches:
            for x in pc.value_counts(b.column(0)).to_pylist():
                counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
            counts = shrink(counts, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"])
    return run


def frequent_digests(rows: DataFrame, share: float = 1 / 2000, counters: int = 8000) -> DataFrame:
    """Every digest with more than ``share`` of the rows, and few others.

    A summary undercounts a digest by at most its partition's rows / (counters + 1),
    so a frequent digest's counts add up to more than (share - 1 / (counters + 1)) of
    all rows; at most 1 / that many digests can: 2,667 with the defaults.
    """
    if share <= 1 / (counters + 1):
        raise ValueError("share must exceed 1 / (counters + 1)")
    least = (share - 1 / (counters + 1)) * rows.count()
    sums = (rows.select("digest").mapInArrow(_summaries(counters), "digest binary, n long")
            .groupBy("digest").agg(F.sum("n").alias("n")))
    return sums.where((F.col("n") >= F.lit(least)) & (F.col("n") > 1)).select("digest")


def _winners(rows: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), *id_key(F.col("id")))).alias("best")
    return (rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("best.id").alias("keep_id"), "group_size"))


def verdicts(rows: DataFrame, share: float = 1 / 2000, counters: int = 8000) -> DataFrame:
    """id, digest, keep_id, group_size, kept for each row of a stored digest table."""
    hot = store(frequent_digests(rows, share, counters), "hot-digests")
    # at most 1 / (share - 1 / (counters + 1)) rows of 32 bytes: safe to broadcast at any size
    of_hot = rows.join(F.broadcast(hot), "digest", "left_semi")
    rest = rows.join(F.broadcast(hot), "digest", "left_anti")
    won = store(_winners(of_hot), "hot-winners")
    both = of_hot.join(F.broadcast(won), "digest").unionByName(rest.join(_winners(rest), "digest"))
    return both.select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                share: float = 1 / 2000, counters: int = 8000) -> DataFrame:
    """One row per row of ``docs``: id, digest, keep_id, group_size, kept."""
    return verdicts(store(digest_rows(docs, id_col, text_col), "digests"), share, counters)


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    marked = docs.withColumn("__digest", text_digest(F.col(text_col)))
    stay = marked.join(kept, marked[id_col].eqNullSafe(kept["__id"]) & (marked["__digest"] == kept["__digest"]), "left_semi")
    return stay.dropDuplicates([id_col, "__digest"]).drop("__digest")

"""Merkle dataset manifest with nested-interval labels. DataFrame functions only.

Leaves are ranked within their group (a source). A node of level ``k`` carries the
half-open interval ``[lo, hi)`` of the leaf ranks below it; ``fanout`` consecutive
nodes of a level make one of the next until a group has a single node, its subroot.
The subroots are the leaves of one more tree of the same kind, whose top is the root.

Ancestors are attached by containment: a node meets the node of the next level with
the same group and the same bucket ``lo div fanout^(level + 1)`` whose interval holds
its own. A parent keeps its children's intervals, so a node's siblings are the parent's
intervals without the node's own: those that end before it stand left, the others right.
Walking down from the top, every node hands its children the steps above it; the leaves
below one parent share them, so a leaf's proof is put together in the task that returns it
and is never shuffled.

Ranks need no task per group: rows are range-partitioned by (group, order), a row's place
in its partition comes from the sort, and the counts of the partitions before are added
from one row per (group, partition). A group with a third of all rows spans many partitions.

Edge cases: a null field has its own leaf encoding (``-``), so null and empty text differ;
a null source is a group of its own and the first; null ids come first in their group; rows
that repeat an id are leaves of their own, ordered by leaf digest; a null id is never
tampered with by the query; texts of any length are hashed whole; an empty table gives an
empty result and has no root; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import store

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field_text(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def record_digest(values: list[Column]) -> Column:
    """Digest of a record, as lowercase hex."""
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def joined(digests: Column) -> Column:
    """An array of hex digests as one text."""
    return F.array_join(digests, "")


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0) and ``n`` (row count) within their group."""
    cuts = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    # the low 33 bits of the id count a partition's rows, in their order
    sorted_rows = rows.repartitionByRange(*cuts).sortWithinPartitions(*cuts)
    placed = store(sorted_rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), name)
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    of_group = Window.partitionBy(group)  # one row per (group, partition)
    before = F.sum("size").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col(group).alias("g"), F.col("part").alias("p"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(of_group).alias("n"))
    met = placed.join(runs, placed[group].eqNullSafe(runs["g"]) & (placed["part"] == runs["p"]))
    return met.select(*rows.columns, (F.col("at") + F.col("shift")).alias("rank"), "n")


def _level(nodes: DataFrame, width: int, payload: list[str]) -> DataFrame:
    """The level above ``nodes`` (grp, lo, hi, n, digest); a group of one node keeps its digest and has no ``steps`` here."""
    kid = F.struct("lo", "hi", "digest", *payload)
    up = nodes.groupBy("grp", "n", F.expr(f"lo div {width}").alias("bucket")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
    alone = F.col("n") == 1
    return up.select("grp", F.element_at("kids", 1)["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "n",
                     F.when(alone, F.element_at("kids", 1)["digest"]).otherwise(F.sha2(joined(F.col("kids")["digest"]), 256)).alias("digest"),
                     "kids", (F.col("n") <= F.lit(width)).alias("top"), alone.alias("same"))


class Tree:
    """Levels of a forest: one tree per group over ranked leaves (grp, rank, n, digest, ``payload`` ...)."""

    def __init__(self, leaves: DataFrame, payload: list[str], fanout: int = 16, name: str = "merkle"):
        self.fanout, self.payload, self.name = fanout, payload, name
        nodes = leaves.select("grp", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "n", "digest", *payload)
        width, self.levels = fanout, [store(_level(nodes, fanout, payload), f"{name}-1")]
        tallest = self.levels[0].agg(F.max("n")).first()[0] or 0
        while width < tallest:
            below, width = self.levels[-1].where(~F.col("top")), width * fanout
            self.levels.append(store(_level(below.select("grp", "lo", "hi", "n", "digest"), width, []), f"{name}-{len(self.levels) + 1}"))

    def subroots(self) -> DataFrame:
        """(grp, digest) of each group's last node."""
        return reduce(DataFrame.unionByName, [x.where("top").select("grp", "digest") for x in self.levels])

    def descend(self, above: DataFrame) -> DataFrame:
        """Each leaf (grp, lo, digest, ``payload`` ...) with ``steps`` up to the root and the columns of ``above``.

        ``above``: one row per group: g, ``steps`` over the subroot, and what else is known of it.
        A step holds the siblings left and right of a node, as joined hex text.
        """
        extra = [c for c in above.columns if c not in ("g", "steps")]
        paths = None
        for k in range(len(self.levels) - 1, -1, -1):
            now, width = self.levels[k], self.fanout ** (k + 2)
            found = now.where("top").join(above, F.col("grp").eqNullSafe(F.col("g"))).select(*now.columns, "steps", *extra)
            if paths is not None:
                parent = paths.select(F.col("grp").alias("p_grp"), F.expr(f"lo div {width}").alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                                      F.col("kids").alias("p_kids"), F.col("steps").alias("p_steps"), *extra)
                mine = now.where(~F.col("top")).withColumn("bucket", F.expr(f"lo div {width}"))
                holds = (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
                met = mine.join(parent, F.col("grp").eqNullSafe(F.col("p_grp")) & (F.col("bucket") == F.col("p_bucket")) & holds)
                steps = F.concat(F.array(siblings(F.col("p_kids"), F.col("lo"), F.col("hi"))), F.col("p_steps"))
                found = found.unionByName(met.select(*now.columns, steps.alias("steps"), *extra))
            paths = store(found, f"{self.name}-paths-{k + 1}") if k else found
        kid = paths.select("grp", "same", F.explode("kids").alias("kid"), "kids", "steps", *extra)
        own = F.when(F.col("same"), F.col("steps")).otherwise(
            F.concat(F.array(siblings(F.col("kids"), F.col("kid.lo"), F.col("kid.hi"))), F.col("steps")))
        return kid.select("grp", F.col("kid.lo").alias("rank"), F.col("kid.digest").alias("digest"), *[F.col(f"kid.{c}").alias(c) for c in self.payload],
                          own.alias("steps"), *extra)


def siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """The children's intervals without ``[lo, hi)``: digests left and right of it."""
    left = F.filter(kids, lambda k: k["hi"] <= lo)
    right = F.filter(kids, lambda k: k["lo"] >= hi)
    return F.struct(joined(left["digest"]).alias("left"), joined(right["digest"]).alias("right"))


def proof_text(steps: Column) -> Column:
    """All siblings from the leaf's level up, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def fold(digest: Column, steps: Column) -> Column:
    """The root that follows from a leaf's digest and its siblings."""
    return F.aggregate(steps, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def no_steps() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source",
             evidence: Column | None = None, fanout: int = 16) -> DataFrame:
    """One row per row of ``docs``: id, group, rank, leaf, evidence, subroot, root, steps.

    ``evidence``: digest of the record as it is claimed to be now (default: the leaf itself);
    a record is what it was if ``fold(evidence, steps)`` equals ``root``.
    """
    leaf = record_digest([F.col(c) for c in fields])
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("grp"), leaf.alias("digest"),
                       (leaf if evidence is None else evidence).alias("evidence"))
    forest = Tree(ranked(rows, "grp", ["id", "digest"], "merkle-leaves"), ["id", "evidence"], fanout, "merkle")
    # the tree over the subroots: one group, its leaves ordered by source
    tops = forest.subroots().select(F.lit("").alias("grp"), F.col("grp").alias("group"), "digest")
    crown = Tree(ranked(tops, "grp", ["group"], "merkle-tops"), ["group"], fanout, "merkle-crown")
    root = crown.subroots().select(F.col("grp").alias("g"), F.col("digest").alias("root"), no_steps().alias("steps"))
    above = store(crown.descend(root).select(F.col("group").alias("g"), "steps", "root", F.col("digest").alias("subroot")), "merkle-above")
    return forest.descend(above).select("id", F.col("grp").alias("group"), "rank", F.col("digest").alias("leaf"), "evidence", "subroot", "root", "steps")


def root_of(spark: SparkSession, leaves: DataFrame) -> str | None:
    """The root of a manifest's rows; None if there are none."""
    row = leaves.select("root").first()
    return row[0] if row else None

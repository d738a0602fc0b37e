"""op13 against SQL and against a plain-Python tree; edge cases."""

import hashlib
import random
import zlib

from fleetscope.llm.merkle_manifest import FIELDS, fold, manifest, proof_text, record_digest, root_of
from fleetscope.llm.q_merkle_manifest import op13_merkle_manifest
from oracle import same_as_sql
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_matches_sql(spark):
    same_as_sql(spark, "op13_merkle_manifest", SF)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(leaves, fanout):
    """(top, siblings' steps of each leaf) by walking the levels."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i in range(len(leaves)):
            run = at[i] // fanout * fanout
            steps[i].append(("".join(level[run:at[i]]), "".join(level[at[i] + 1:run + fanout])))
            at[i] //= fanout
        level = [digest(*level[k:k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], steps


def brute(rows, fanout=16):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        tops[name] = tree([x[2] for x in groups[name]], fanout)
    root, upper = tree([tops[n][0] for n in names], fanout)
    out = []
    for name, above in zip(names, upper):
        for (_, _, h, r), steps in zip(groups[name], tops[name][1]):
            steps = steps + above
            now = leaf((*r[:4], lowered(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else h
            for left, right in steps:
                now = digest(left, now, right)
            out.append((r[0], h, tops[name][0], root, digest(*[a + b for a, b in steps]), now, now == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank int, lo string"


def write(spark, rows, tmp_path):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_groups_of_every_height_and_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    sizes = {"hot": 700, "b": 256, "c": 257, "d": 17, "e": 16, "f": 1, "": 3, "é": 2, "Z": 4, None: 5} | {f"s{k:02d}": 1 + k % 3 for k in range(30)}
    ids = iter(rng.sample(range(10_000), 2000))
    rows = [(next(ids), s, rng.choice(["en", None, ""]), rng.choice([None, 5]), f"Some Text {rng.random()} ÄÖ")
            for s, n in sizes.items() for _ in range(n)]
    rows += [(None, "hot", None, None, None), (None, None, "en", 1, "No Id"), (77_777, "hot", "en", 1, "Twice"), (77_777, "hot", "en", 1, "Twice"),
             (77_777, "hot", "en", 1, "twice, other"), (88_888, "d", "en", 0, ""), (88_889, "d", "en", None, None), (88_890, "d", "en", 9, "Long " * 100_000)]
    rng.shuffle(rows)
    got = sorted((tuple(r) for r in op13_merkle_manifest(spark, write(spark, rows, tmp_path)).collect()), key=repr)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_interface_any_fanout_lone_rows_and_empty_tables(spark):
    rows = [(i, f"g{i % 2}" if i else None, "en", i, f"t{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest(docs, fanout=3)
    want = {r[0]: r for r in brute(rows, 3)}
    for r in got.select("*", proof_text(F.col("steps")).alias("proof"), fold(F.col("leaf"), F.col("steps")).alias("back")).collect():
        assert (r.leaf, r.subroot, r.root, digest(r.proof)) == want[r.id][1:5] and r.back == r.root
    changed = manifest(docs, evidence=record_digest([*[F.col(c) for c in FIELDS[:-1]], F.lit("other")]), fanout=3)
    assert changed.where(fold(F.col("evidence"), F.col("steps")) == F.col("root")).count() == 0
    assert root_of(spark, manifest(docs.limit(1))) == leaf(docs.first())
    assert manifest(docs.limit(0)).count() == 0 and root_of(spark, manifest(docs.limit(0))) is None


def test_ranks_of_a_hot_group_come_from_many_partitions(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'hot' AS source", "'en' AS lang", "1L AS n_chars", "'t' AS text")
    ranks = manifest(docs).select("id", "rank").collect()
    assert all(r.id == r.rank for r in ranks) and len(ranks) == 5000

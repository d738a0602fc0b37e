"""op13: Merkle manifest of ``documents``, with a tamper check of every fifth row by crc32."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.merkle_manifest import FIELDS, LOWER, UPPER, fold, manifest, proof_text, record_digest


def _levels(name: str, src: str, levels: int) -> str:
    """CTEs of a tree over ``src`` (g, i, n, h): levels ``name``0 ... with each node's left and right siblings."""
    out = [f"{name}0 AS (SELECT g, i, n, h FROM {src})"]
    for k in range(levels):
        up = (f"SELECT g, i // 16 AS i, n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE n > {16 ** k} GROUP BY g, i // 16, n")
        sides = (f"SELECT g, i, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                 f"coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r "
                 f"FROM {name}{k} WHERE n > {16 ** k}")
        out += [f"{name}{k + 1} AS ({up})", f"{name}s{k} AS ({sides})"]
    return ",\n".join(out)


def _climb(name: str, src: str, levels: int, proof: str, folded: str) -> str:
    """CTEs that carry (id, g, i0, proof, folded) of ``src`` up through the levels of a tree."""
    out = [f"{name}c0 AS (SELECT *, {proof} AS p0, {folded} AS f0 FROM {src})"]
    for k in range(levels):
        out.append(f"{name}c{k + 1} AS (SELECT c.*, p{k} || coalesce(s.l || s.r, '') AS p{k + 1}, CASE WHEN s.l IS NULL THEN f{k} ELSE sha256(s.l || f{k} || s.r) END AS f{k + 1} "
                   f"FROM {name}c{k} c LEFT JOIN {name}s{k} s ON s.g IS NOT DISTINCT FROM c.g_{name} AND s.i = c.i_{name} // {16 ** k})")
    return ",\n".join(out)


LEVELS, TOPS = 6, 4
_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in FIELDS[:-1])
_LOW = f"translate(text, '{UPPER}', '{LOWER}')"

#: Trees of up to 16^6 leaves per source and 16^4 sources.
SQL = f"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_step AS (SELECT i, c FROM bits WHERE k = 8),
crc(id, s, pos, c) AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR), 0, 4294967295 FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT id, s, pos + 1, xor(crc.c >> 8, t.c) FROM crc JOIN crc_step t ON t.i = xor(crc.c, ord(s[pos + 1])) & 255 WHERE pos < length(s)),
crcs AS (SELECT id, xor(c, 4294967295) AS crc FROM crc WHERE pos = length(s)),
d AS (SELECT doc_id, source, sha256({_HEAD} || {_FIELD.format('text')}) AS leaf,
        CASE WHEN crc % 5 = 0 THEN sha256({_HEAD} || {_FIELD.format(_LOW)}) ELSE sha256({_HEAD} || {_FIELD.format('text')}) END AS claim
      FROM documents LEFT JOIN crcs ON id = doc_id),
x AS (SELECT *, source AS g_a, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i_a, count(*) OVER (PARTITION BY source) AS n FROM d),
{_levels('a', '(SELECT g_a AS g, i_a AS i, n, leaf AS h FROM x)', LEVELS)},
sub AS ({' UNION ALL '.join(f"SELECT g, h FROM a{k} WHERE i = 0 AND n <= {16 ** k} AND n > {16 ** (k - 1) if k else 0}" for k in range(LEVELS + 1))}),
y AS (SELECT g AS src, 0 AS g_b, h AS subroot, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i_b, count(*) OVER () AS m FROM sub),
{_levels('b', '(SELECT g_b AS g, i_b AS i, m AS n, subroot AS h FROM y)', TOPS)},
top AS ({' UNION ALL '.join(f"SELECT h FROM b{k} WHERE i = 0 AND n <= {16 ** k} AND n > {16 ** (k - 1) if k else 0}" for k in range(TOPS + 1))}),
{_climb('a', 'x', LEVELS, "''", 'claim')},
z AS (SELECT c.*, y.g_b, y.i_b, y.subroot FROM ac{LEVELS} c JOIN y ON y.src IS NOT DISTINCT FROM c.g_a),
{_climb('b', f'(SELECT * EXCLUDE ({", ".join(f"p{k}, f{k}" for k in range(LEVELS))}) RENAME (p{LEVELS} AS pa, f{LEVELS} AS fa) FROM z)', TOPS, 'pa', 'fa')}
SELECT doc_id, leaf, subroot, h AS root, sha256(p{TOPS}) AS proof_sha256, f{TOPS} AS folded_root, f{TOPS} = h AS verified
FROM bc{TOPS}, top
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = manifest(docs, evidence=record_digest([*[F.col(c) for c in FIELDS[:-1]], text]))
    folded = rows.select("*", F.sha2(proof_text(F.col("steps")), 256).alias("proof_sha256"), fold(F.col("evidence"), F.col("steps")).alias("folded_root"))
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

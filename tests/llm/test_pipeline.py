"""The pipeline against a brute-force version of its deciding stages."""

import re

import corpus_pipeline
from test_bm25_packing import check_cover
from test_simhash_pivots import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def template_words(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def brute(docs, items):
    """{doc_id: text} that should survive; items whole in a text are leaks."""
    docs = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    best = {}
    for i, t in docs.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        rank = (-len(t), i)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, i)
    docs = {i: docs[i] for _, i in best.values()}
    ids = sorted(docs)
    root = brute_components(ids, [brute_fp(docs[i]) for i in ids])
    docs = {i: t for i, t in docs.items() if root[i] == i}
    return {i: t for i, t in docs.items() if not any(template_words(b) in template_words(t) for b in items)}


def test_run_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = brute({r.doc_id: r.text for r in rows}, items)
    check_cover(corpus_pipeline.run(spark, SF).collect(), list(left.items()))


def test_stages_keep_columns_and_stand_odd_rows(spark, tmp_path):
    words = [f"w{i}x" for i in range(60)]
    leak = "the quick brown fox jumps over 12 lazy dogs while Anna counts 30 sheep in the meadow near Oslo"
    rows = [(1, " ".join(words), "en", "a", None, 1), (2, "  ".join(words) + " ", "en", "a", 3, 2), (3, None, None, None, None, None),
            (4, "", "en", "a", 0, 0), (5, "123 ... 456", "en", "a", 0, 0), (6, "Some words first. " + leak.replace("12", "77").replace("30", "99") + " and more of it.", "en", "b", 0, 0),
            (7, "lone text " * 3000, "fr", "b", 0, 0), (7, "lone text " * 3000, "fr", "b", 0, 0), (None, "a text without any id at all here", "en", "c", 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"], name
        kept.append(sorted(-1 if r.doc_id is None else r.doc_id for r in docs.collect()))
    assert kept == [[-1, 1, 2, 6, 7, 7], [-1, 2, 6, 7], [-1, 2, 6, 7], [-1, 2, 7]]
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == {None, 2, 7}
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name

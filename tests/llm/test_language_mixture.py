"""op5: held-out accuracy, mixtures, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from fleetscope.llm.language_mixture import em, identify, infer, train
from fleetscope.llm.q_language_mixture import op5_language_mixture

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op5_language_mixture(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_mixtures_get_their_languages_and_shares(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, model = train(docs)
    by = {lang: " ".join(r.text for r in docs.where(F.col("lang") == lang).limit(6).collect()).split()[:600] for lang in ("en", "de")}
    shares, has = infer(model, [" ".join(by["en"][:400] + by["de"][:200]), " ".join(by["de"])])
    assert has.all()
    en, de = langs.index("en"), langs.index("de")
    assert abs(shares[0, en] - 2 / 3) < 0.1 and abs(shares[0, de] - 1 / 3) < 0.1 and shares[0].argmax() == en
    assert shares[1, de] > 0.95 and (shares[1] > 0).sum() == 1


def test_em_is_a_likelihood_maximum():
    rng = np.random.default_rng(0)
    score = rng.normal(0, 2, (40, 3))
    doc = np.repeat([0, 1], 20)
    share, like = em(score, doc, 2, np.ones((2, 3)), rounds=300)
    for d in range(2):
        for _ in range(200):
            other = rng.dirichlet(np.ones(3))
            assert np.log(np.exp(score[doc == d]) @ other).sum() <= like[d] + 1e-6
    assert np.allclose(share.sum(axis=1), 1)


def test_edge_cases(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "12 34 !?", "en", 1), (4, "the cat sat on the mat", "en", 1), (4, "the cat sat on the mat", "en", 1),
            (5, "der Hund und die Katze", "de", 1), (6, "THE CAT *** the mat!!", None, 1), (7, "the mat " * 50_000, None, 1), (8, "日本語", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    langs, model = train(docs)
    assert langs == ["de", "en"]
    got = {r.doc_id: r["__language"] for r in identify(docs, langs, model).collect()}
    assert [got[i].lang for i in range(1, 8)] == ["und", "und", "und", "en", "de", "en", "en"] and got[1].score == 0 and got[8].lang in langs
    none, nothing = train(docs.limit(0))
    assert none == [] and {r["__language"].lang for r in identify(docs, none, nothing).collect()} == {"und"}
    assert identify(docs.limit(0), langs, model).count() == 0


def test_only_letters_count_beyond_the_basic_plane(spark):
    rows = [(1, "\U0001F600\U0001F680 \U0001F600", "en"), (2, "12 \U0001F44D 34", "en"), (3, "the cat \U0001F431 sat", "en"), (4, "\U00010400\U00010401", None),
            (5, "the cat sat", "en"), (6, "der Hund und die Katze", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r["__language"] for r in identify(docs, *train(docs)).collect()}
    assert [(got[i].lang, got[i].score) for i in (1, 2)] == [("und", 0.0)] * 2
    assert got[3].lang == "en" and got[4].lang != "und"

"""op2: held-out accuracy, gradients, edge cases."""

import numpy as np

from fleetscope.llm.quality_mil import N_FEATURES, _gradients, _pool, _sigmoid, encode, fit, score, score_texts, train
from fleetscope.llm.q_quality_mil import op2_quality_mil

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = op2_quality_mil(spark, SF).join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    assert np.mean(right) > 0.97 and np.mean([x for x, r in zip(right, rows) if r.quality == 0]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(1)
    x, owner, y = rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0, 1, 0])
    m = {"mean": np.zeros(5), "std": np.ones(5), "W": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)),
         "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "d": np.array(0.3)}

    def loss():
        p = _sigmoid(_pool(x, owner, 4, m)["logit"])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    grads = _gradients(x, owner, y, m)
    for k in ("W", "b", "V", "U", "w", "c"):
        for i in list(np.ndindex(m[k].shape))[:6]:
            old = m[k][i]
            m[k][i] = old + 1e-5
            up = loss()
            m[k][i] = old - 1e-5
            down = loss()
            m[k][i] = old
            assert abs((up - down) / 2e-5 - grads[k][i]) < 1e-6


def test_attention_finds_the_deciding_passage():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600, N_FEATURES)).astype(np.float32)
    owner = np.repeat(np.arange(100), 6)
    y = np.arange(100) % 2
    x[np.arange(100) * 6 + rng.integers(0, 6, 100), 3] += np.where(y == 1, 8, 0)
    m = fit(x, owner, y.astype(float), epochs=60)
    f = _pool(x, owner, 100, m)
    assert np.mean((f["logit"] > 0) == y) > 0.95


def test_edge_cases(spark):
    assert encode([""])[0].shape == (1, N_FEATURES) and encode([None, "a " * 1000, "x" * 300_000])[1].tolist().count(1) > 10
    good, bad = "a plain sentence about cats and dogs. " * 9, "BUY!! NOW!! $$$ ### !!! " * 9
    rows = [(i, good if i % 2 else bad, i % 2) for i in range(80)] + [(100, None, 1), (101, "", 0), (102, good * 2000, None), (102, good * 2000, None)]
    docs = spark.createDataFrame([(i, t, 7.0) for i, t, _ in rows], "doc_id long, text string, y double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:-1]], "doc_id long, quality int")
    model = train(docs, labels)
    got = {r.doc_id: r["__score"] for r in score(docs, model).collect()}
    assert got[1] > 0.9 and got[0] < 0.1 and got[102] > 0.9 and all(0 <= s <= 1 for s in got.values())
    assert train(docs, labels.limit(0)) is None and score_texts(["a", None], None).tolist() == [0.5, 0.5]
    assert score(docs.limit(0), model).count() == 0

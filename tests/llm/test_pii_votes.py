"""op3: base spans against the plain patterns, EM, edge cases."""

import hashlib
import re

import numpy as np

from fleetscope.llm.pii_votes import CODES, KINDS, accepted, find_personal_data, luhn, proposals, reliabilities
from fleetscope.llm.q_pii_votes import op3_pii_votes

SF = "/root/testdata/sf0.01"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                  "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_whole_table_base_spans(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_pii_votes(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in PLAIN]
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert sum(r.n_email for r in rows) and sum(r.n_card for r in rows) and sum(r.n_phone for r in rows)


def test_awkward_texts_match_the_plain_patterns():
    rng = np.random.default_rng(3)
    parts = ["a.b", "@", "x-y", ".", "com", " ", "-", "+", "1", "23", "255", "256", "(", ")", "4111", "é", "[at]", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 25)))
        got = [f"{k}:{a}:{b}" for k, a, b, base in proposals(text) if base]
        assert got == brute(text), text


def test_linear_on_long_runs():
    for unit in ("a", "1", "1.", "+1 ", "@", "a@", "1-", "(at)"):
        proposals(unit * 200_000)


def test_em_finds_the_unreliable_labeler():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.4
    right = np.array([0.95, 0.9, 0.55, 0.85, 0.8])
    v = np.where(rng.random((len(y), 5)) < right, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    v[rng.random(v.shape) < 0.2] = 0
    patterns, which, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    p, found = reliabilities(patterns, n)
    assert np.mean((p[which.ravel()] > 0.5) == y) > 0.95
    assert np.argmin(found["hit"]) == 2 and abs(found["prior"] - 0.4) < 0.05


def test_edge_cases_and_added_spans(spark):
    text = "call me, phone (575) 555-9977 today; write to jo.doe [at] example [dot] com now. version 1.2.3.999"
    rows = [(1, None, 1), (2, "", 2), (3, text, 3), (3, text, 3), (4, "no data here " * 20000, 4)] + [
        (10 + i, f"phone +1 (57{i % 10}) 555-99{i:02d} and tel 57{i % 10}-555-99{i:02d} or a{i}@b.com", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    found, report = find_personal_data(docs)
    got = {r.id: [(s.kind, s.start, s.stop) for s in r.spans] for r in found.collect()}
    assert got[1] == got[2] == got[4] == []
    assert ("phone", text.index("("), text.index(" today")) in got[3]
    assert not any(k == "ip" for k, _, _ in got[3]) and set(report) <= set(KINDS)
    assert find_personal_data(docs.limit(0))[0].count() == 0
    assert accepted([]) == ([], {}) and CODES > 0

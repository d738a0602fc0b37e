"""op9: base places against brute force, method's labels, edge cases."""

import re

from fleetscope.llm.license_index import BASE, Template, scan
from fleetscope.llm.q_license_index import op9_license_index

SF = "/root/testdata/sf0.01"
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_whole_table_base_places(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_license_index(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        for line, label in (("GNU General Public License, version 3", "gpl-3"), ("All rights reserved", "all-rights-reserved")):
            assert (line in docs[r.doc_id]) <= (label in r.labels.split(","))
    assert sum(r.n_base for r in rows) > 10


def test_edge_cases(spark):
    long = "x the mit license " * 30000 + "cc-by.nc"
    rows = [(1, None, 0), (2, "", 0), (3, " ,;", 0), (4, "Under THE (MIT) License under the mit license", 1), (4, "Under THE (MIT) License under the mit license", 1),
            (5, long, 2), (6, "éunder the mit license. CC BY NC cc by nc by nc", 0),
            (7, "Permission is hereby granted, free of charge, to any person getting a copy of this software", 0), (8, "rights reserved all", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int")
    got = {r.id: r for r in scan(docs).collect()}
    labels = {i: sorted({f.label for f in r.found}) for i, r in got.items()}
    assert [got[i].n_words for i in (1, 2, 3)] == [0, 0, 0] and labels[1] == labels[3] == labels[8] == []
    assert [sorted(f.places) for f in got[4].found if f.base] == [[0, 4]]
    assert labels[5] == ["cc-by-nc", "mit"]
    assert [sorted(f.places) for f in got[6].found if f.base] == [[4, 7]]
    assert labels[7] == ["mit"] and 0.8 < got[7].score < 1
    assert scan(docs.limit(0)).count() == 0
    one = scan(docs, templates=BASE + (Template.of("x", "any person getting"),)).where("id = 7").first()
    assert [f.label for f in one.found] == ["x"]


def test_places_whose_rare_words_differ(spark):
    text = "the terms of the gnu general public license as published by the one soft software two version 3 of the license"
    docs = spark.createDataFrame([(1, text), (2, text.replace("version 3", "version 2"))], "doc_id long, text string")
    got = {r.id: [(f.label, f.places) for f in r.found] for r in scan(docs).collect()}
    assert got == {1: [("gpl-3", [0])], 2: []}

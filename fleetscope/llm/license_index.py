"""License scan by a positional rare-token index. DataFrame functions only.

The templates (license sentences) are indexed by position on the words that are rarest
in the corpus: document frequencies of all template words are counted over all
documents, and every template is posted under its ``index_words`` words of highest IDF and
under the rarest word of its mandatory phrases, so that no place is missed.
A file looks up those words where they occur; each meeting of an occurrence at word p
with a posting at offset o places the template at p - o. A place counts if all
mandatory key phrases stand at their relative positions and at least ``share`` of the
template's words stand at theirs. Base phrases are templates whose key phrase is the
whole phrase, so every place of a phrase is found.

Both passes are map-only over the texts; only the document frequencies of the template
words, a few hundred numbers at most, are shuffled and reach the driver.

Edge cases: null and empty texts have no words, no places and score 0; a long text costs
time in proportion to its words; a place counts once however many of its words led to
it; repeated rows each get a row; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract: what separates words, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: (offset, words) of each mandatory phrase
    keys: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool = False

    @classmethod
    def of(cls, label: str, text: str, *phrases: str, base: bool = False) -> Template:
        words = tuple(text.split())
        keys = []
        for p in phrases or (text,):
            part = tuple(p.split())
            keys.append((next(i for i in range(len(words)) if words[i:i + len(part)] == part), part))
        return cls(label, words, tuple(keys), base)


#: Fixed by the contract: base phrases and their labels.
BASE = (
    Template.of("mit", "under the mit license", base=True),
    Template.of("apache-2", "apache license version 2", base=True),
    Template.of("cc-by-nc", "cc by nc", base=True),
)
#: Further templates: sentence, then its mandatory phrases.
MORE = (
    Template.of("mit", "released under the mit license", "mit license"),
    Template.of("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template.of("mit", "spdx license identifier mit"),
    Template.of("apache-2", "licensed under the apache license version 2 0", "apache license", "2 0"),
    Template.of("apache-2", "spdx license identifier apache 2 0"),
    Template.of("cc-by-nc", "creative commons attribution noncommercial 4 0 international", "creative commons attribution noncommercial"),
    Template.of("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template.of("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template.of("gpl-3", "the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
                "gnu general public license", "version 3"),
    Template.of("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
                "redistribution and use in source and binary forms"),
    Template.of("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license", "2 0"),
    Template.of("all-rights-reserved", "all rights reserved"),
)


def word_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS).alias("parts"))
    lead = (F.get("parts", F.lit(0)) == "").cast("int")
    tail = ((F.element_at("parts", -1) == "") & (F.size("parts") > 1)).cast("int")
    return rows.select("id", F.slice("parts", lead + 1, F.size("parts") - lead - tail).alias("words"))


def inverse_frequencies(rows: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each vocabulary word over all rows (id, words)."""
    seen = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    # the outer generator keeps Spark from pushing a filter with the whole expression below
    counts = {r.word: r.n for r in rows.select(F.explode_outer(F.concat(seen, F.array(F.lit("")))).alias("word"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = counts.get("", 0)  # every row adds one empty word
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def _word_at(place: Column, offset: int, word: str) -> Column:
    return F.coalesce(F.get("words", place + offset) == word, F.lit(False))


def _agreement(t: Template, place: Column) -> Column:
    return reduce(lambda a, b: a + b, [_word_at(place, k, w).cast("int") for k, w in enumerate(t.words)]) / len(t.words)


def _places(t: Template, rare: list[str], share: float) -> Column:
    """Word positions where a template stands."""
    starts = F.array_distinct(F.concat(*[_shifted(w, o) for o, w in enumerate(t.words) if w in rare]))

    def stands(place: Column) -> Column:
        keys = [_word_at(place, o + k, w) for o, part in t.keys for k, w in enumerate(part)]
        return reduce(lambda a, b: a & b, keys, (place >= 0)) & (F.lit(True) if t.base else _agreement(t, place) >= share)
    return F.filter(starts, stands)


def _shifted(word: str, offset: int) -> Column:
    return F.transform(F.filter("hits", lambda i: F.get("words", i) == word), lambda i: i - offset)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = BASE + MORE,
         index_words: int = 3, share: float = 0.6) -> DataFrame:
    """(id, n_words, found, score) of every row of ``docs``.

    ``found``: array of (label, base, places, score), a template each, those with places.
    """
    rows = word_rows(docs, id_col, text_col)
    idf = inverse_frequencies(rows, sorted({w for t in templates for w in t.words}))
    by_rarity = lambda t: sorted(set(t.words), key=lambda w: (-idf[w], w))
    # a base place holds all its words, so its rarest one finds every place
    # a key phrase stands at every place, so its rarest word finds those whose other words differ
    in_key = lambda t: [w for w in by_rarity(t) if any(w in part for _, part in t.keys)][:1]
    rare = [by_rarity(t)[:1] if t.base else by_rarity(t)[:index_words] + in_key(t) for t in templates]
    looked_up = sorted({w for r in rare for w in r})
    n = F.size("words")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    hits = rows.select("id", "words", F.filter(index, lambda i: F.get("words", i).isin(looked_up)).alias("hits"))
    placed = hits.select("id", "words", n.cast("long").alias("n_words"),
                         *[_places(t, r, share).alias(f"p{k}") for k, (t, r) in enumerate(zip(templates, rare))])
    each = [F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.col(f"p{k}").alias("places"),
                     (F.lit(1.0) if t.base else F.coalesce(F.array_max(_agreements(t, k)), F.lit(0.0))).alias("score"))
            for k, t in enumerate(templates)]
    out = placed.select("id", "n_words", F.filter(F.array(*each), lambda x: F.size(x["places"]) > 0).alias("found"))
    return out.withColumn("score", F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)))


def _agreements(t: Template, k: int) -> Column:
    return F.transform(F.col(f"p{k}"), lambda place: _agreement(t, place))

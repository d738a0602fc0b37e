"""Language ID as inference of a mixture of languages.

Training counts character n-grams (n = 1..3, hashed to ``2 ** BITS`` bins) of all
labelled documents, per language. A document is cut into segments of ``seg_words``
words; under each language a segment has the log-likelihood of its n-grams.
Expectation-maximisation estimates the document's language proportions from these.
The language set is chosen by penalised likelihood: languages are added in the order
of their proportions for as long as twice the gain in log-likelihood exceeds
``penalty * ln(segments)``. The prediction is the largest proportion within the set,
the score that proportion.

Edge cases: null text, or text without a letter, gets ``und`` with score 0; without
any labelled document every document is ``und``; equal proportions go to the language
that sorts first; repeated rows each get a row; an empty table gives an empty result.
A text of any length is segmented whole, in the task that holds the row. Only text and
language enter: further columns are never read, a column ``__language`` would be overwritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import small_batches

BITS = 16
ORDERS = (1, 2, 3)
#: Odd multipliers that spread an n-gram's code points over the bins.
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
SPACE = 32


def _letter_table() -> np.ndarray:
    """Code point (below 2**16) -> itself if a letter, else a space."""
    return np.array([c if chr(c).isalpha() else SPACE for c in range(1 << 16)], np.uint32)


_LETTERS: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Lower-cased code points, everything but letters replaced by spaces, runs kept."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    low = codes < 1 << 16
    out = np.where(low, _LETTERS[0][np.minimum(codes, (1 << 16) - 1)], codes)
    if not low.all():
        seen, which = np.unique(codes[~low], return_inverse=True)
        out[~low] = np.array([c if chr(c).isalpha() else SPACE for c in seen.tolist()], np.uint32)[which]
    return out


def words_only(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with single spaces, index of each word's first one, document of each word)."""
    parts, of = [], []
    for i, t in enumerate(texts):
        c = letters(t or "")
        if len(c):
            parts += [np.array([SPACE], np.uint32), c]
            of.append((i, len(c) + 1))
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([*parts, np.array([SPACE], np.uint32)])
    doc = np.concatenate([np.repeat([i for i, _ in of], [n for _, n in of]), [of[-1][0]]])
    space = codes == SPACE
    keep = ~space
    keep[:-1] |= space[:-1] & ~space[1:]  # the last space of a run
    keep[-1] = True
    codes, doc = codes[keep], doc[keep]
    start = np.flatnonzero((codes[:-1] == SPACE) & (codes[1:] != SPACE))
    return codes, start, doc[start + 1]


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Bin of the n-gram that begins at each position (orders kept apart by their sum)."""
    h = np.full(len(codes), n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h[:len(codes) - k] ^= (codes[k:] + np.uint32(k + 1)) * MIX[k]
        h = h * np.uint32(0x2C1B3C6D) ^ (h >> np.uint32(13))
    return h >> np.uint32(32 - BITS)


def _chunks(texts: list, size: int) -> Iterator[tuple[int, list]]:
    """Runs of texts of about ``size`` characters: (index of the first, texts)."""
    first, held, run = 0, 0, []
    for i, t in enumerate(texts):
        if run and held + len(t or "") > size:
            yield first, run
            first, held, run = i, 0, []
        run.append(t)
        held += len(t or "")
    if run:
        yield first, run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        by: dict[str, list] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            total = counts.setdefault(lang, np.zeros((len(ORDERS), 1 << BITS), np.int64))
            for _, run in _chunks(texts, 1 << 19):
                codes, start, _ = words_only(run)
                if not len(start):
                    continue
                inside = np.flatnonzero(codes[:-1] != SPACE) if len(codes) else start
                for row, n in enumerate(ORDERS):
                    at = inside if n == 1 else np.arange(max(0, len(codes) - n + 1))
                    total[row] += np.bincount(grams(codes, n)[at], minlength=1 << BITS)
    for lang, total in counts.items():
        row, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(row)), pa.array(row.astype(np.int32)), pa.array(gram.astype(np.int32)), pa.array(total[row, gram])],
            ["lang", "n_row", "gram", "n"])


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [language, order, bin]) from all labelled rows.

    The driver receives at most 3 * 2**16 sums per language, whatever the corpus.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string"), F.col(text_col))
    sums = rows.mapInArrow(_count, "lang string, n_row int, gram int, n long").groupBy("lang", "n_row", "gram").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    table = np.zeros((len(langs), len(ORDERS), 1 << BITS), np.float64)
    if langs:
        which = np.searchsorted(np.array(langs, object), np.array(got.column("lang").to_pylist(), object))
        table[which, got.column("n_row").to_numpy(), got.column("gram").to_numpy()] = got.column("n").to_numpy()
    table += 0.1
    return langs, np.log(table / table.sum(axis=2, keepdims=True)).astype(np.float32)


def segment_scores(model: np.ndarray, codes: np.ndarray, start: np.ndarray, doc: np.ndarray,
                   seg_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood [segment, language], document of each segment)."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    within = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    heads = np.flatnonzero(within % seg_words == 0)
    at = start[heads]
    score = np.zeros((len(at), len(model)), np.float64)
    end = len(codes) - 1
    for row, n in enumerate(ORDERS):
        g = grams(codes, n)
        for k in range(len(model)):
            gain = model[k, row][g]
            gain[codes == SPACE] *= n > 1
            gain[max(0, end - n + 2):] = 0
            score[:, k] += np.add.reduceat(gain, at)
    return score / len(ORDERS), doc[heads]


def em(score: np.ndarray, doc: np.ndarray, n_docs: int, allowed: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [document, language] and log-likelihoods under the allowed languages.

    ``doc`` ascends; every document has a segment and an allowed language.
    """
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.diff(np.append(first, len(doc)))[:, None]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    top = score.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(score - top, -80.0))
    for _ in range(rounds):
        part = like * share[doc]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, first, axis=0) / size
    total = np.log((like * share[doc]).sum(axis=1)) + top[:, 0]
    return share, np.add.reduceat(total, first)


def infer(model: np.ndarray, texts: list, seg_words: int = 8, penalty: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [text, language], has a letter [text]); rows of zeros without letters."""
    n_lang = len(model)
    out = np.zeros((len(texts), n_lang))
    for offset, run in _chunks(texts, 1 << 19):
        codes, start, doc = words_only(run)
        if not len(start) or not n_lang:
            continue
        score, seg_doc = segment_scores(model, codes, start, doc, seg_words)
        seen, seg_doc = np.unique(seg_doc, return_inverse=True)
        n = np.bincount(seg_doc)
        full, _ = em(score, seg_doc, len(seen), np.ones((len(seen), n_lang)))
        first = np.flatnonzero(np.diff(seg_doc, prepend=-1))
        alone = np.add.reduceat(score, first, axis=0)
        # the best single language leads; the others follow by their proportions
        full[np.arange(len(seen)), alone.argmax(axis=1)] += 1
        order = np.argsort(-full, axis=1, kind="stable")
        best = np.zeros((len(seen), n_lang))
        best[np.arange(len(seen)), order[:, 0]] = 1
        reached, active = alone.max(axis=1), np.arange(len(seen))
        for size in range(2, n_lang + 1):  # until no document gains; one language more each time
            allowed = np.zeros((len(active), n_lang))
            np.put_along_axis(allowed, order[active, :size], 1.0, axis=1)
            mine = np.isin(seg_doc, active)
            share, like = em(score[mine], np.searchsorted(active, seg_doc[mine]), len(active), allowed)
            gained = 2 * (like - reached[active]) > penalty * np.log(n[active] + 1.0)
            best[active[gained]], reached[active[gained]] = share[gained], like[gained]
            active = active[gained]
            if not len(active):
                break
        out[offset + seen] = best
    has = out.sum(axis=1) > 0
    return out, has


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, text_col: str = "text", seg_words: int = 8,
             penalty: float = 2.0) -> DataFrame:
    """``docs`` with column ``__language``: struct(lang, score, langs, shares)."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # languages * 3 * 2**16 floats
    kind = "lang string, score double, langs array<string>, shares array<double>"

    @F.pandas_udf(kind)
    def language(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            share, has = infer(held.value, s.tolist(), seg_words, penalty)
            rows = []
            for p, ok in zip(share, has):
                if not ok:
                    rows.append(("und", 0.0, [], []))
                    continue
                k = [int(i) for i in np.argsort(-p, kind="stable") if p[i] > 0]
                rows.append((langs[k[0]], float(min(1.0, p[k[0]])), [langs[i] for i in k], [float(p[i]) for i in k]))
            yield pd.DataFrame(rows, columns=["lang", "score", "langs", "shares"])

    return docs.withColumn("__language", language(F.col(text_col)))


def fit_identify(docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Train on the rows where ``learn`` holds, then identify all rows of ``docs``."""
    langs, model = train(docs.where(learn), lang_col, text_col)
    return identify(docs, langs, model, text_col)

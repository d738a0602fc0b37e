"""Quality classifier by gated attention over the passages of a document.

Every passage (``PASSAGE`` words) of a text is encoded: shares of character classes,
word shapes and repetition, plus hashed character pairs, projected and squashed to a
passage representation h. Gated attention weights
``a = softmax(w . (tanh(V h) * sigmoid(U h)))`` pool the representations of a document,
and a logistic unit scores the pooled one. All weights are learnt together from
document labels by gradient descent on a bounded sample of labelled rows
(``max_docs`` documents by hash order, at most ``max_passages`` evenly spaced passages of
each); scoring reads every passage of every text.

Edge cases: null and empty texts are one passage without words and get a score like
any other; a text without spaces is one passage; without labelled rows the score is 0.5;
labels that are null are not used; repeated rows each get a row; an empty table gives
an empty result. A text of any length is scored by all its passages, in the task that holds
the row; training takes up to ``max_passages`` of a labelled text. Only text (and the label
of training rows) is read; a column ``__score`` would be overwritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import small_batches

PASSAGE = 48
PAIRS = 64
#: Character classes, as text: the code points of each class make one feature.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "|", "*", "#", "%", "&",
           "$", "\n", "-", "_", "/", ":", ";", "(", ")", "<", ">", "@", "=", "+", "'", '"')
N_CLASSES = len(CLASSES) + 4  # and: space, upper and lower case beyond ASCII, all others
N_FEATURES = N_CLASSES + 8 + PAIRS

_CLASS: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    table = np.full(1 << 16, N_CLASSES - 1, np.uint8)
    for c in range(128, 1 << 16):
        ch = chr(c)
        table[c] = N_CLASSES - 3 if ch.isupper() else N_CLASSES - 2 if ch.isalpha() else N_CLASSES - 1
    for k, chars in enumerate(CLASSES):
        table[[ord(x) for x in chars]] = k
    table[32] = table[9] = table[13] = N_CLASSES - 4
    return table


def _entropy_rows(passage: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distinct words / words of each passage."""
    order = np.lexsort((h, passage))
    p, x = passage[order], h[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (x[1:] != x[:-1])
    return np.bincount(p[new], minlength=len(n)) / np.maximum(n, 1)


def encode(texts: list, passage_words: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features [passage, N_FEATURES], text of each passage); a passage or more for every text."""
    if not _CLASS:
        _CLASS.append(_class_table())
    blobs = [(t or "").encode("utf-32-le", "replace") + b"\n\0\0\0" for t in texts]
    codes = np.frombuffer(b"".join(blobs), np.uint32)
    length = np.array([len(b) // 4 for b in blobs])
    text_start = np.concatenate([[0], np.cumsum(length)[:-1]])
    kind = _CLASS[0][np.minimum(codes, (1 << 16) - 1)]
    blank = (kind == N_CLASSES - 4) | (codes == 10)
    word_start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    word_text = np.searchsorted(text_start, word_start, "right") - 1
    # passages: each text's first character opens one, and every passage_words-th word
    first = np.searchsorted(word_text, np.arange(len(texts)))
    nth = np.arange(len(word_start)) - first[word_text]
    cut = word_start[(nth % passage_words == 0) & (nth > 0)]
    heads = np.union1d(text_start, cut)
    owner = np.searchsorted(text_start, heads, "right") - 1
    n = len(heads)
    size = np.diff(np.append(heads, len(codes)))
    passage = np.repeat(np.arange(n), size)
    out = np.zeros((n, N_FEATURES), np.float32)
    counts = np.bincount(passage * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out[:, :N_CLASSES] = counts / size[:, None]
    # words: a hash from the code points, which end at the next blank
    in_word = np.where(blank, 0, codes).astype(np.uint64)
    place = np.arange(len(codes), dtype=np.uint64)
    if len(word_start):
        offset = place - np.repeat(word_start.astype(np.uint64), np.diff(np.append(word_start, len(codes)))) if word_start[0] == 0 else \
            place - np.concatenate([np.zeros(word_start[0], np.uint64), np.repeat(word_start.astype(np.uint64), np.diff(np.append(word_start, len(codes))))])
        value = in_word * (offset * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
        word_hash = np.add.reduceat(value, word_start)
        word_size = np.add.reduceat((~blank).astype(np.int64), word_start)
        of = passage[word_start]
        words = np.bincount(of, minlength=n)
        safe = np.maximum(words, 1)
        same = np.zeros(len(word_start))
        same[1:] = (word_hash[1:] == word_hash[:-1]) & (of[1:] == of[:-1])
        upper = kind[word_start] == 1
        k = N_CLASSES
        out[:, k] = np.log1p(words) / 4
        out[:, k + 1] = np.bincount(of, word_size, n) / safe / 10
        out[:, k + 2] = np.sqrt(np.maximum(np.bincount(of, word_size ** 2.0, n) / safe - (out[:, k + 1] * 10) ** 2, 0)) / 10
        out[:, k + 3] = np.bincount(of, same, n) / safe
        out[:, k + 4] = _entropy_rows(of, word_hash, words)
        out[:, k + 5] = np.bincount(of, upper, n) / safe
        out[:, k + 6] = np.bincount(of, word_size == 1, n) / safe
        out[:, k + 7] = np.log1p(size) / 8
    low = np.where(kind == 1, codes + 32, codes)
    pair = ((low[:-1] * np.uint32(0x9E3779B1) ^ low[1:] * np.uint32(0x85EBCA77)) >> np.uint32(26)).astype(np.int64)
    share = np.bincount(passage[:-1] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) / size[:, None]
    out[:, N_CLASSES + 8:] = np.sqrt(share)
    return out, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pool(x: np.ndarray, owner: np.ndarray, n: int, m: dict) -> dict:
    """Forward pass: passage features to one score logit per document."""
    h = np.tanh((x - m["mean"]) / m["std"] @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * s) @ m["w"]
    first = np.searchsorted(owner, np.arange(n))
    top = np.maximum.reduceat(e, first)
    a = np.exp(e - top[owner])
    a /= np.add.reduceat(a, first)[owner]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "first": first, "logit": z @ m["c"] + m["d"]}


def _gradients(x, owner, y, m) -> dict:
    n = len(y)
    f = _pool(x, owner, n, m)
    g = (_sigmoid(f["logit"]) - y) / n
    dz = g[:, None] * m["c"]
    da = (dz[owner] * f["h"]).sum(axis=1)
    dh = f["a"][:, None] * dz[owner]
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["first"])[owner])
    dt, ds = de[:, None] * m["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * m["w"] * f["t"] * f["s"] * (1 - f["s"])
    dh = dh + dt @ m["V"].T + ds @ m["U"].T
    du = dh * (1 - f["h"] ** 2)
    return {"W": ((x - m["mean"]) / m["std"]).T @ du, "b": du.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds,
            "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ g, "d": g.sum()}


def fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40,
        rate: float = 0.01, decay: float = 1e-4, batch: int = 128, seed: int = 7) -> dict:
    """Adam on the log loss; ``owner`` ascends over 0 .. len(y) - 1."""
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    m = {"mean": x.mean(axis=0), "std": x.std(axis=0) + 1e-3, "W": rng.normal(0, f ** -0.5, (f, hidden)), "b": np.zeros(hidden),
         "V": rng.normal(0, hidden ** -0.5, (hidden, gate)), "U": rng.normal(0, hidden ** -0.5, (hidden, gate)),
         "w": rng.normal(0, gate ** -0.5, gate), "c": np.zeros(hidden), "d": np.zeros(())}
    first, last = np.searchsorted(owner, np.arange(len(y))), np.searchsorted(owner, np.arange(len(y)), "right")
    names = ("W", "b", "V", "U", "w", "c", "d")
    mom, var, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            docs = order[at:at + batch]
            rows = np.concatenate([np.arange(first[d], last[d]) for d in docs])
            of = np.repeat(np.arange(len(docs)), last[docs] - first[docs])
            grads = _gradients(x[rows], of, y[docs], m)
            step += 1
            for k in names:
                g = grads[k] + decay * m[k]
                mom[k], var[k] = 0.9 * mom[k] + 0.1 * g, 0.999 * var[k] + 0.001 * g * g
                slow = rate * (1 - epoch / epochs) + 1e-4
                m[k] = m[k] - slow * (mom[k] / (1 - 0.9 ** step)) / (np.sqrt(var[k] / (1 - 0.999 ** step)) + 1e-8)
    return {k: np.asarray(v, np.float32) for k, v in m.items()}


def _runs(texts: list, size: int = 1 << 19) -> Iterator[list]:
    run, held = [], 0
    for t in texts:
        if run and held + len(t or "") > size:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t or "")
    if run:
        yield run


def score_texts(texts: list, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    out = []
    for run in _runs(texts):
        x, owner = encode(run)
        out.append(_sigmoid(_pool(x, owner, len(run), model)["logit"].astype(np.float64)))
    return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_docs: int = 6000, max_passages: int = 64) -> dict | None:
    """Weights from a sample of at most ``max_docs`` labelled rows (smallest id hashes).

    The driver receives at most max_docs * max_passages feature rows of 0.4 kB.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("y"))
              .orderBy(F.xxhash64("__id"), "__id").limit(max_docs))
    # at most max_docs rows of 16 bytes are broadcast
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).join(F.broadcast(sample), "__id").select("__id", "y", "t")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ys = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, t in enumerate(b.column(2).to_pylist()):
                x, _ = encode([t])
                if len(x) > max_passages:
                    x = x[np.linspace(0, len(x) - 1, max_passages).astype(int)]
                yield pa.RecordBatch.from_arrays([pa.array([str(ids[i])]), pa.array([ys[i]]), pa.array([x.tobytes()], pa.binary())], ["id", "y", "x"])

    got = rows.mapInArrow(features, "id string, y double, x binary").collect()
    got.sort(key=lambda r: (r.id, r.y, bytes(r.x)))
    if not got:
        return None
    parts = [np.frombuffer(bytes(r.x), np.float32).reshape(-1, N_FEATURES) for r in got]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return fit(np.concatenate(parts).astype(np.float32), owner, np.array([r.y for r in got]))


def score(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """``docs`` with column ``__score``: probability that the label is 1."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series(score_texts(s.tolist(), held.value))

    return docs.withColumn("__score", quality(F.col(text_col)))

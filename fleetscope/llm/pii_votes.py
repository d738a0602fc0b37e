"""Personal data by weak supervision.

Permissive patterns propose spans. Five labelers vote on each (+1 personal, -1 not, 0
abstain): a strict format check (regex and checksum), a gazetteer (top-level domains,
card prefixes, dialling codes, reserved address ranges), cue words in the context,
the characters beside the span, and the variety of its digits. Expectation-maximisation
over the counts of vote patterns estimates each labeler's reliability per kind without
any labels. A logistic span classifier is then trained on the resulting probabilities,
with the votes and coarse span features as inputs. The base matches stay whatever the
classifier says; the spans it accepts beyond them are added.

Only counts per (kind, vote and feature code) reach the driver: a code has at most
``CODES`` values. The scan is map-only and its candidates are stored, not the texts.

Edge cases: null text is empty; an empty text has no spans (its hash is that of the
empty string); every pattern takes time in proportion to the text; a repeated row
gets its own result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import small_batches, store

#: Kinds in the order of the output; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "ssn")

# Base patterns, fixed by the contract. Possessive repeats and lookbehinds only keep
# them linear; they match what the plain forms match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Further candidates.
AT_WORDS = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}){1,4}")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Gazetteers: fixed values, as text.
TLDS = frozenset("com org net edu gov mil int info biz io co us uk de fr es it nl eu ch at be se no dk fi pl cz pt ie ru cn jp kr in br mx ar ca au nz za".split())
DIAL = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52",
        "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420", "971")
CARD_PREFIX = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65")
CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write to|correo)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|login|from)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|tarjeta|carte|karte)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|cell|dial|tel[eé]fono|telefon)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|social)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:version|isbn|order|invoice|ticket|section|chapter|page|build|release)\b")
N_VOTES = 5
CODES = 3 ** N_VOTES * 12


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1) if at >= end else None
        start = at
        while m and start > end and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _strict(kind: str, span: str) -> bool:
    if kind == "ip":
        return all(map(_octet, span.split(".")))
    n = _digits(span)
    if kind == "card":
        return 16 <= len(n) <= 19 and luhn(n)
    if kind == "phone":
        return 8 <= len(n) <= 15
    return True


def proposals(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, is a base match) in the order of kinds, then start."""
    out = [("email", a, b, True) for a, b in _emails(text)] if "@" in text else []
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, m.start(), m.end(), _strict(kind, m[0])) for m in pattern.finditer(text)]
    more = []
    if "[at]" in text or "(at)" in text:
        more += [("email", *m.span()) for m in AT_WORDS.finditer(text)]
    for kind, pattern in (("phone", LOCAL_PHONE), ("ssn", SSN)):
        more += [(kind, *m.span()) for m in pattern.finditer(text)]
    if more:
        taken = sorted((a, b) for _, a, b, base in out if base)
        starts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else []
        for kind, a, b in more:
            i = int(np.searchsorted(starts, b)) if taken else 0
            if not i or reach[i - 1] <= a:
                out.append((kind, a, b, False))
        out.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return out


def votes(text: str, kind: str, start: int, end: int, base: bool) -> list[int]:
    span, before = text[start:end], text[max(0, start - 40):start]
    n = _digits(span)
    if kind == "email":
        tail = re.split(r"[.\s\])]+", span)[-1].lower()
        listed = 1 if tail in TLDS else -1
        varied = 1 if len(set(span)) > 5 else 0
    else:
        varied = -1 if len(set(n)) <= 2 else 1
        if kind == "ip":
            listed = -1 if span.split(".")[0].lstrip("0") in ("", "255") or span.endswith(".0.0") else 1
        elif kind == "card":
            listed = 1 if CARD_PREFIX.match(n) else -1
        elif kind == "phone":
            listed = 1 if (n.startswith(DIAL) if span[0] == "+" else n[0] not in "01") else -1
        else:
            listed = -1 if n[:3] in ("000", "666") or n[0] == "9" or n[3:5] == "00" or n[5:] == "0000" else 1
    cue = 1 if CUES[kind].search(before) else -1 if AGAINST.search(before) else 0
    left, right = text[start - 1:start], text[end:end + 1]
    beside = -1 if (left.isalnum() or right.isalnum() or left in ("-", "_", "/") and left) else 1
    strict = 1 if base else 0 if kind in ("email", "ssn") or (kind == "phone" and span[0] != "+") else -1
    return [strict, listed, cue, beside, varied]


def code_of(text: str, kind: str, start: int, end: int, base: bool) -> int:
    """Votes in base 3, then length class (0..2), separators (0/1) and base (0/1)."""
    code = 0
    for v in votes(text, kind, start, end, base):
        code = code * 3 + v + 1
    span = text[start:end]
    size = len(_digits(span)) if kind != "email" else len(span)
    code = code * 3 + (0 if size < 10 else 1 if size < 16 else 2)
    return (code * 2 + (" " in span or "-" in span)) * 2 + base


def _decode(code: int) -> tuple[list[int], list[int]]:
    base, code = code % 2, code // 2
    sep, code = code % 2, code // 2
    size, code = code % 3, code // 3
    v = []
    for _ in range(N_VOTES):
        v.append(code % 3 - 1)
        code //= 3
    return v[::-1], [size, sep, base]


def reliabilities(v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict]:
    """EM for one kind: P(personal | votes) of each pattern, and the labelers' rates.

    ``v`` [pattern, labeler] in {-1, 0, 1}, ``n`` counts. Weak Beta priors say that a
    labeler is right more often than wrong.
    """
    up, down = (v == 1).astype(float), (v == -1).astype(float)
    hit, false, prior = np.full(v.shape[1], 0.8), np.full(v.shape[1], 0.2), 0.5
    for _ in range(rounds):
        a = np.log(prior) + up @ np.log(hit) + down @ np.log(1 - hit)
        b = np.log(1 - prior) + up @ np.log(false) + down @ np.log(1 - false)
        p = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
        w, u = n * p, n * (1 - p)
        hit = (w @ up + 8) / (w @ (up + down) + 10)
        false = (u @ up + 2) / (u @ (up + down) + 10)
        prior = (w.sum() + 1) / (n.sum() + 2)
    return p, {"prior": float(prior), "hit": hit.tolist(), "false": false.tolist()}


def span_classifier(x: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = 400, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic model fitted to probabilities ``p`` with weights ``n``."""
    w = np.zeros(x.shape[1])
    n = np.log1p(n)
    n = n / n.sum()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (n * (q - p)) * len(w) + 1e-3 * w)
    return w


def _inputs(codes: list[int]) -> np.ndarray:
    rows = []
    for c in codes:
        v, (size, sep, _) = _decode(c)
        rows.append([1.0, *v, *[float(x == 0) for x in v], *[float(size == k) for k in range(3)], float(sep)])
    return np.array(rows)


def accepted(counts: list[tuple[str, int, int]], threshold: float = 0.5) -> tuple[list[int], dict]:
    """Codes (kind number * CODES + code) that the final classifier accepts, and what EM found.

    ``counts``: (kind, code, number of spans).
    """
    keep, report = [], {}
    for k, kind in enumerate(KINDS):
        mine = sorted((c, n) for name, c, n in counts if name == kind)
        if not mine:
            continue
        codes, n = [c for c, _ in mine], np.array([n for _, n in mine], float)
        v = np.array([_decode(c)[0] for c in codes])
        p, report[kind] = reliabilities(v, n)
        x = _inputs(codes)
        q = 1 / (1 + np.exp(-np.clip(x @ span_classifier(x, p, n), -30, 30)))
        # a span whose format check failed is not personal data, however it looks
        keep += [k * CODES + c for c, s, row in zip(codes, q, v) if s >= threshold and row[0] >= 0]
    return keep, report


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: array of (kind, start, stop, base, code), code points, end exclusive."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("code", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                text = text or ""
                out.append([(k, s, e, base, KINDS.index(k) * CODES + code_of(text, k, s, e, base))
                            for k, s, e, base in proposals(text)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(span))], ["id", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id {kind}, spans array<struct<kind:string,start:long,stop:long,base:boolean,code:int>>")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> tuple[DataFrame, dict]:
    """((id, spans: array of (kind, start, stop, base)), what EM found per kind)."""
    found = store(candidates(docs, id_col, text_col), "pii-candidates")
    counts = (found.select(F.inline("spans")).groupBy("kind", "code").agg(F.count(F.lit(1)).alias("n"))).collect()
    keep, report = accepted([(r.kind, r.code % CODES, r.n) for r in counts], threshold)
    chosen = F.filter("spans", lambda s: s["base"] | (s["code"].isin(keep) if keep else F.lit(False)))
    return found.select("id", chosen.alias("spans")), report

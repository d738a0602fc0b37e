"""Token ids of a ``tokenizers`` BPE file, several times faster on ordinary text.

``load(path)`` reads the JSON file. For byte-level files of the two shapes known here
the vocabulary and merge order are handed to ``tiktoken``'s merge loop, which yields
the same ids; texts with any character outside a plain Latin range go through the
``tokenizers`` library itself, as does everything if the file has another shape or
if the two disagree on a probe text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters on which both libraries' character classes surely agree.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-įı-ɏ‐-‧€]")
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
GPT_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The word-end files' split pattern, for the characters above.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
WORD_SPLIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+")
WORD_SPLIT_SOURCE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PROBE = "It's 42 naïve Größen, ¿señor?  <|x|> I'll\tgo\n\nto https://example.com/a_b?c=1&d=2 — “ok” \n end1234 ÇA "


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """``encode(texts)`` gives each text's ids as an array of unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(path)
        self.size = self.slow.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._fast(spec)
        if self.fast and self.fast([PROBE])[0].tolist() != self._slow(PROBE).tolist():
            self.fast = None

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def _fast(self, spec: dict):
        import tiktoken
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        vocab, symbols = model["vocab"], byte_of_symbol()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if model.get("type") != "BPE" or spec.get("post_processor") or model.get("dropout") or model.get("ignore_merges"):
            return None
        ends = model.get("end_of_word_suffix") or ""
        shape = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex"), spec.get("normalizer"), ends)
        words = ends == "</w>" and WORD_SPLIT_SOURCE in json.dumps(before).encode().decode("unicode_escape").replace("\\\\", "\\")
        if shape != ("ByteLevel", False, True, None, "") and not words:
            return None
        ids = np.zeros(len(vocab) + 1024, np.uint32)
        rank: dict[bytes, int] = {}

        def add(key: bytes, token: str) -> None:
            ids[len(rank)] = vocab.get(token, 0)
            rank.setdefault(key, len(rank))

        for s, b in sorted(symbols.items(), key=lambda x: x[1]):
            add(bytes([b]), s)
        if words:  # a zero byte ends each word; merging it with the last byte comes first
            for s, b in sorted(symbols.items(), key=lambda x: x[1]):
                if b:
                    add(bytes([b, 0]), s + ends)
        for merge in model["merges"]:
            token = "".join(merge if isinstance(merge, list) else merge.split(" "))
            bare = token.removesuffix(ends) if ends else token
            key = bytes(symbols[c] for c in bare) + (b"\0" if bare != token else b"")
            if key in rank or token not in vocab:
                return None
            add(key, token)
        split = r"[^\x00]+\x00" if words else GPT_SPLIT
        core = tiktoken.Encoding("file", pat_str=split, mergeable_ranks=rank, special_tokens={})
        apart = re.compile("|".join(map(re.escape, added))) if added else None
        closing = np.zeros(len(ids), bool)
        closing[[r for key, r in rank.items() if len(key) > 1 and key.endswith(b"\0")]] = True

        def by_text(texts: list[str]) -> list[np.ndarray]:
            return [ids[core.encode_to_numpy(t, disallowed_special=())] for t in texts]

        def by_word(texts: list[str]) -> list[np.ndarray]:
            """White space always separates, so each different run between white space is
            split and merged once; texts are then put together from these."""
            runs = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
            per_text = np.diff(runs.offsets.to_numpy())
            coded = runs.flatten().dictionary_encode()
            run_of, different = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            pieces = [(r,) if r.isalpha() else WORD_SPLIT.findall(r) for r in different]
            if not any(pieces):
                return [np.zeros(0, np.uint32) for _ in texts]
            tokens = core.encode_to_numpy("\0".join(chain.from_iterable(pieces)) + "\0", disallowed_special=())
            # a token that closes a piece is its last
            closed = np.concatenate([[0], np.flatnonzero(closing[tokens]) + 1])
            n = np.fromiter(map(len, pieces), np.int64, len(pieces))
            end, start = closed[np.cumsum(n)], closed[np.cumsum(n) - n]
            size = (end - start)[run_of]
            upto = np.concatenate([[0], np.cumsum(size)])
            flat = np.repeat(start[run_of] - upto[:-1], size)
            flat += np.arange(len(flat))
            return np.split(ids[tokens][flat], upto[np.cumsum(per_text)][:-1])

        def run(texts: list[str]) -> list[np.ndarray]:
            plain = [i for i, t in enumerate(texts) if not (apart and apart.search(t))]
            out: list = [None] * len(texts)
            for i, tokens in zip(plain, (by_word if words else by_text)([texts[i] for i in plain])):
                out[i] = tokens
            return [self._slow(t) if x is None else x for t, x in zip(texts, out)]
        return run

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each text; the more texts at once, the less is merged twice."""
        texts = [t or "" for t in texts]
        plain = [i for i, t in enumerate(texts) if self.fast is not None and not (CONTROL if t.isascii() else UNUSUAL).search(t)]
        out: list = [None] * len(texts)
        if plain:
            for i, tokens in zip(plain, self.fast([texts[i] for i in plain])):
                out[i] = tokens
        return [self._slow(t) if x is None else x for t, x in zip(texts, out)]


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One encoder for each file and process."""
    return Bpe(path)

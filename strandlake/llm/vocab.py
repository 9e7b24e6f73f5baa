"""Byte-level BPE vocabularies from tokenizer files of the installed libraries."""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Pre-token pattern of byte-level BPE, fixed by the vocabulary's own format.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points below this have the same class in every Unicode version that the libraries know.
SETTLED = "՘"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """ids of byte strings, ranks of mergeable pairs, and special tokens of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bytes_of = _byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes = {i: bytes(bytes_of[c] for c in t) for t, i in vocab.items()}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte_id = np.array([next(i for c, i in ((c, vocab[c]) for c, x in bytes_of.items() if x == b)) for b in range(256)], np.int64)
        self.size = max(self.bytes) + 1
        self.path = path
        self.pattern = regex.compile(PATTERN)
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._settled = regex.compile(f"[^\x00-{chr(ord(SETTLED) - 1)}]")
        # ids in merge order are ranks, so the faster library gives the same ids
        self.ranked = bool((np.diff(self.merged) > 0).all() and self.merged[0] > self.byte_id.max())
        self.fast = (
            tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items() if i not in self.special.values()}, special_tokens=self.special)
            if self.ranked
            else None
        )

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's own, which few texts need."""
        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def encode(self, text: str) -> list[int]:
        """ids as the tokenizers library gives them with add_special_tokens=False."""
        if self.fast is not None:
            return self.fast.encode(text, allowed_special="all")
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens: (piece, whether it is one)."""
        if self._special is None:
            return [(text, False)]
        return [(p, p in self.special) for p in self._special.split(text) if p]

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a piece without special tokens."""
        if self._settled.search(text):  # the library's own classes for newer characters
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)

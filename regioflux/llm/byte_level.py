"""Token ids of byte-level BPE vocabularies, as their tokenizer file gives them, and the bytes of each token.

A file whose merges stand in the order of their ids, as the common ones do, is run by the faster of the two installed libraries from its own
vocabulary; both then give the same ids (a test compares them around every code point). Any other file, and any text with a run of white
space so long that the faster one's splitting pattern runs out of stack, goes to the file's own library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: Fixed value: how byte-level vocabularies of this kind split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_RUN = re.compile(r"(?:^|\S)\s{10000}")


def spelling() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _in_order(described: dict) -> bool:
    """Whether merging the pair of the least id first is what the file says."""
    model, split = described["model"], described["pre_tokenizer"] or {}
    if described["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        return False
    plain = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
    if model["type"] != "BPE" or any(model.get(k) for k in plain):
        return False
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    singles = [i for token, i in model["vocab"].items() if len(token) == 1]
    return bool(made) and made[0] > max(singles) and all(a < b for a, b in zip(made[:-1], made[1:], strict=True)) and len(made) + len(singles) == len(model["vocab"])


class ByteLevel:
    """One worker's tokenizer. With added, the file's added tokens are found in texts, else their strings are ordinary text."""

    def __init__(self, path: str, added: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        of, vocab = spelling(), described["model"]["vocab"]
        self.tokens = {i: bytes(of[c] for c in token) if all(c in of for c in token) else token.encode() for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.tokens |= {i: content.encode() for content, i in self.special.items()}
        self.path, self.added, self._own, self._fast = path, added, None, None
        self._plain_special = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in described["added_tokens"])
        if _in_order(described):
            import tiktoken

            ranks = {self.tokens[i]: i for i in vocab.values() if i not in self.special.values()}
            self._fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> np.ndarray:
        special = {content for content in self.special if content in text} if self.added else set()
        if self._fast is None or special and not self._plain_special or len(text) > 10000 and _LONG_RUN.search(text):
            return self._slowly(text)
        return self._fast.encode_to_numpy(text, allowed_special=special, disallowed_special=())

    def _slowly(self, text: str) -> np.ndarray:
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.path)
            self._own.encode_special_tokens = not self.added
        return np.array(self._own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        parts = [self.encode(t) for t in texts]
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0)).astype(np.uint32), counts


_tokenizers: dict[tuple[str, bool], ByteLevel] = {}


def byte_level(path: str, added: bool) -> ByteLevel:
    """The tokenizer of a worker process, made when it is first needed."""
    if (path, added) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path, added] = ByteLevel(path, added)
    return _tokenizers[path, added]


def in_slices(texts: list[str], size: int) -> Iterator[list[str]]:
    """Texts in runs of about so many characters; a longer text is a run of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield texts[first:i]
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield texts[first:]

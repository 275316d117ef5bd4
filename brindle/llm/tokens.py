"""Byte-level BPE ids of whole texts.

The ids are those of the tokenizer file: its merges, read as ranks, run in the faster of the two
public BPE libraries (tests hold both equal). Texts that contain the string of a special token are
encoded by the file's own library.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np

#: How a text is cut before merges: contractions, letters, digits, other marks, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class ByteBPE:
    """ids(text) and byte spans for the vocabulary in a tokenizers file of kind byte-level BPE."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = {c: b for b, c in _byte_letters().items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.width = np.zeros(size, np.int64)  # bytes that each id covers
        self.ranks = {}
        for word, i in vocab.items():
            if word in self.special:
                continue
            raw = bytes(letters[c] for c in word)
            self.width[i] = len(raw)
            self.ranks[raw] = i
        for word, i in self.special.items():
            self.width[i] = len(word.encode())
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        import tiktoken

        self.own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def whole(self):
        """The file's own library; loaded only where a text asks for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def raw(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if self._special is not None and self._special.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.own.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), dtype="<u4")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte as a printable letter: itself, or else the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    """One per worker process and file."""
    return ByteBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

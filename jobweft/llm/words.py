"""Words and word sequences of a text, as every operator of this subpackage counts them."""

from __future__ import annotations

import html
import re

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters without width, and the soft hyphen.
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"

_TAG = re.compile(r"<[^>]*>")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_WORD = re.compile(r"[^\W_]+")


def clean(text: str) -> str:
    """Tags become blanks, entities are decoded, invisible characters deleted, letters lowered."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    return _WORD.findall(clean(text)) if text else []


class WordHashes(dict):
    """64-bit hash of each word, the same in every process; emptied when it grows large."""

    limit = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text_words: list[str]) -> np.ndarray:
        return np.array([self[w] for w in text_words], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all sequences of n consecutive words, in order, repeats kept."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i]
    return mix(total)


class Sequences:
    """Hashes of the n-word sequences of many texts, made in one pass over all their words. Repeats are kept."""

    def __init__(self, texts: list[list[str]], n: int, hashes: WordHashes):
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        flat = np.array([hashes[w] for t in texts for w in t], dtype=np.uint64)
        self.values = sequence_hashes(flat, n)  # those that run over the end of a text are never read
        self.starts = np.cumsum(lengths) - lengths
        self.counts = np.maximum(lengths - n + 1, 0)

    def __len__(self) -> int:
        return len(self.counts)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.starts[i] : self.starts[i] + self.counts[i]]


def text_column(*parts: str) -> Column:
    """The parts joined by blanks, null as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(p), F.lit("")) for p in parts])

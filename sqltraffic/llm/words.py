"""Words of UTF-8 texts as runs of bytes: lower-cased A-Z, and [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after that.

In UTF-8 every byte of a character beyond ASCII is 0x80 or more, so the pattern means the same for bytes as for
characters: 0-9, a-z and all of 0x80 to 0xFF are parts of words, and all else stands between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What each byte becomes: itself, its lower-case letter, or a space.
FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())

_BASE = np.uint64(0x9E3779B97F4A7C15)


def raw(texts: pa.Array) -> pa.Array:
    """Texts as bytes."""
    return texts.cast(pa.large_binary())


def pieces(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists of those of about `size` bytes, so that a very long text takes no more memory at once."""
    text, at = text.translate(FOLDED), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of folded bytes begin and end; no word crosses an edge, where a text begins or the last ends."""
    inside = data != 0x20
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = edges[edges < len(data)]
    begin[cut] = inside[cut]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = edges[(edges > 0) & (edges <= len(data))] - 1
    end[cut] = inside[cut]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever it stands: the sum of its bytes times powers of an odd number."""
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    powers = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64))
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    terms = data[at + np.repeat(starts, sizes)].astype(np.uint64) * powers[at]
    return np.add.reduceat(terms, np.cumsum(sizes) - sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    """The same numbers with their bits spread."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))

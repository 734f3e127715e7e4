"""Sets of hashed word shingles, by numpy over the bytes of Arrow columns, all texts of a portion at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import kept

#: Words in a shingle.
WORDS = 5
#: Bytes of text that are hashed at once; a longer text is taken by itself.
STRIDE = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[0x41:0x5B] += 0x20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OF_BYTE = np.random.default_rng(0x5EED).integers(0, 1 << 64, 256, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a sum count alike."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _ODD, and of its inverse; those of one stride are kept by the worker."""
    of = lambda base, m: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, base, np.uint64)]))
    both = lambda m: (of(_ODD, m), of(_ODD_INVERSE, m))
    return both(n) if n > STRIDE + 1 else tuple(x[:n] for x in kept("powers", lambda: both(STRIDE)))


def _word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts that lie between `bounds`, A to Z in lower case; and where each text's words begin."""
    raw = _SMALL[raw]
    blank = np.append(_BLANK[raw], True)
    before = np.append(True, blank[:-2]) if len(raw) else np.empty(0, bool)
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[first] = True  # a text's first byte opens a word
    starts = np.flatnonzero(~blank[:-1] & before)
    after = blank[1:].copy()
    after[first[first > 0] - 1] = True  # and the byte before it closes one
    ends = np.flatnonzero(~blank[:-1] & after) + 1
    n = len(raw)
    with np.errstate(over="ignore"):
        # Sums of byte values times powers of an odd number, taken back to the word's first place.
        powers, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_OF_BYTE[raw] * powers[:n], out=sums[1:])
        words = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, bounds)


def _combined(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words that follow each other."""
    total = np.full(1, np.uint64(k))
    with np.errstate(over="ignore"):
        for j in range(k):
            total = total * _ODD + words[j : len(words) - k + 1 + j]
        return mixed(total)


def _sets(raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    words, at = _word_hashes(raw, bounds)
    all_of = _combined(words, WORDS) if len(words) >= WORDS else np.empty(0, np.uint64)
    out = []
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if high - low < WORDS:
            out.append(_combined(words[low:high], high - low) if high > low else np.empty(0, np.uint64))
            continue
        s = np.sort(all_of[low : high - WORDS + 1])
        new = s[1:] != s[:-1]
        out.append(s if new.all() else s[np.append(True, new)])
    return out


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Of each text its different shingles in ascending order of hash; its whole sequence if it has fewer words; nothing for null."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return []
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data and len(data) else np.empty(0, np.uint8)
    out: list[np.ndarray] = []
    while len(out) < len(texts):
        i = len(out)
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STRIDE, "right")) - 1)
        out += _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    return out


def fingerprints(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits of each whole set: two sums of hashes that do not depend on each other, and its size, mixed; None for an empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    some = sizes > 0
    out: list[bytes | None] = [None] * len(sets)
    if some.any():
        flat, first = np.concatenate(sets), (np.cumsum(sizes) - sizes)[some]
        with np.errstate(over="ignore"):
            sums = np.column_stack([np.add.reduceat(mixed(flat ^ _ODD), first), np.add.reduceat(mixed(flat * _ODD + _ODD_INVERSE), first)])
            names = mixed(mixed(sums + sizes[some].astype(np.uint64)[:, None]) ^ (sums[:, ::-1] * _ODD))
        for i, name in zip(np.flatnonzero(some).tolist(), names, strict=True):
            out[i] = name.tobytes()
    return out

"""Token ids of Arrow columns of texts, by the tokenizers library, each distinct word encoded once.

A byte-level BPE never merges over the edges of its pre-tokens. So a batch of texts is cut at
places that are such edges for certain, the distinct pieces are found by Arrow, and only pieces
not seen before go to the library. Texts with characters for which the cuts below do not hold
(blanks other than space and newline, or anything from U+0800) are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import kept

#: Pieces that a Python worker remembers; beyond it starts anew.
MEMORY = 150_000
#: Bytes of text that are cut up at once.
STRIDE = 4 << 20

_SPACE, _NEWLINE = 0x20, 0x0A
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)  # ASCII signs that cannot be part of a word or of 's, 't and the like
_MARK[[b for b in b'!"#$%&()*+,-./:;<=>?@[]^_{|}~']] = True
_ODD = np.zeros(256, bool)
_ODD[[0x09, 0x0B, 0x0C, 0x0D, *range(0xE0, 0x100)]] = True


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.newline = self.tokenizer.token_to_id("Ċ")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # a piece's place in the arrays below
        self.starts, self.lengths, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, pieces: list[str], starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces)), strict=True))
        self.starts = np.append(self.starts, starts + len(self.ids))
        self.lengths = np.append(self.lengths, ends - starts)
        self.ids = np.append(self.ids, ids)

    def _learn(self, pieces: list[str]) -> None:
        # Words of letters go in one text. Behind a space each begins at an id that opens with a space;
        # without one, line breaks part them.
        spaced = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        bare = [p for p in pieces if p.isalpha()]
        rest = [p for p in pieces if not (p.isalpha() or p[0] == " " and p[1:].isalpha())]
        if spaced:
            ids = self._ask(["".join(spaced)])[0]
            starts = np.flatnonzero(self.opens[ids])
            self._keep(spaced, starts, np.append(starts[1:], len(ids)), ids)
        if bare:
            ids = self._ask(["\n".join(bare)])[0]
            breaks = np.flatnonzero(ids == self.newline)
            self._keep(bare, np.append(0, breaks + 1), np.append(breaks, len(ids)), ids)
        if rest:
            each = self._ask(rest)
            ends = np.cumsum([len(e) for e in each])
            self._keep(rest, np.append(0, ends[:-1]), ends, np.concatenate(each))

    def _cut_up(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: bytes of texts that end at bounds[1:]. Their ids, and where each text's begin."""
        before, two_before = np.roll(data, 1), np.roll(data, 2)
        blank, blank_before = (data == _SPACE) | (data == _NEWLINE), (before == _SPACE) | (before == _NEWLINE)
        wide = (before >= 0x80) & (two_before >= 0xC4) & (two_before <= 0xC9) | (two_before == 0xC3) & (before != 0x97) & (before != 0xB7)
        edge = blank & ~blank_before  # a run of blanks begins
        edge |= _MARK[data] & (_LETTER[before] | wide)  # a word ends
        edge |= ~blank & (before == _NEWLINE) & (two_before != _SPACE) & (two_before != _NEWLINE)  # a line begins
        starts = bounds[:-1][bounds[:-1] < bounds[1:]]
        edge[starts] = True
        cuts = np.append(np.flatnonzero(edge), len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        if missing := [w for w in words if w not in self.known]:
            if self.known and len(self.known) + len(missing) > MEMORY:
                self._forget()
                missing = words
            self._learn(missing)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        starts, lengths = self.starts[at], self.lengths[at]
        index = pieces.indices.to_numpy(zero_copy_only=False)
        n = lengths[index]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(starts[index] - (ends - n), n) + np.arange(n.sum())]
        first = np.append(ends - n, n.sum())[np.searchsorted(cuts[:-1], bounds)]  # of the first piece at or after each bound
        return ids, first

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none), and len(texts) + 1 places at which a text's ids begin or end."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if texts.offset:
            texts = pa.concat_arrays([texts])
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        parts, counts, i = [], [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STRIDE, "right")) - 1)
            some, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            ids, first = self._cut_up(some, bounds) if len(some) else (np.empty(0, np.uint32), np.zeros(j - i + 1, np.int64))
            odd = np.flatnonzero(_ODD[some] | (some == 0xC2))  # C2: U+0085 and U+00A0 are blanks
            found = set(np.searchsorted(bounds, odd, "right") - 1)
            if found:
                own = np.split(ids, first[1:-1])
                for k, whole in zip(found, self._ask([texts[i + int(k)].as_py() for k in found]), strict=True):
                    own[k] = whole
                parts += own
                counts += map(len, own)
            else:
                parts.append(ids)
                counts += np.diff(first).tolist()
            i = j
        return np.concatenate(parts), np.append(0, np.cumsum(counts)).astype(np.int64)


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary file; it is kept from task to task."""
    return kept(f"encoder {path}", lambda: Encoder(path))

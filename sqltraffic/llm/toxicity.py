"""Toxicity by a support vector machine over a gapped-subsequence string kernel.

The kernel of two strings counts the subsequences of four letters that they share, each weighed
by DECAY for every place it spans in either (REACH places at most), and is normed by the strings'
lengths. A string's edge counts as a letter. So an insult keeps most of its likeness with letters inserted, and signs between letters
are not counted at all; letters that stand alone, spaced out, are read as one string.

A sentence is as toxic as its worst string, and ends at a stop before a blank or at a line's end. Landmarks (strings that
set toxic training documents apart, and common clean ones) give the kernel a Nyström map, in which a linear machine with squared
hinge loss is trained on labelled sentences, each through the kernel values of its worst string. Sentences of clean documents are clean;
of a toxic document those are toxic that hold a string beyond chance in toxic documents, and in later rounds those that the machine
holds for it. In each round worst strings and toxic sentences are found anew, and the worst mistakes among clean sentences added. Since its
decision is linear in the kernel, it folds into one weight for each subsequence: a string's value is a sum over those it holds. A
logistic fit turns the WORST largest values of a whole document into a probability.

The training sample is bounded and repeatable: TRAIN_DOCS of each label, texts cut at TRAIN_CHARS.
Scored texts are never cut. A null or empty text, or one whose strings all are shorter than two letters, gets the score of
no match. Without both labels the score is the share of label 1 (0 if there is none). Repeated rows get
equal scores; other columns are carried along.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scored

TRAIN_DOCS, TRAIN_CHARS = 1200, 8_000
LETTERS, DECAY, REACH = 28, 0.7, 5
SEQUENCES = LETTERS**4
#: Letters of a string at most; longer ones are read in pieces of that many, overlapping by half.
LONGEST = 24
LANDMARKS, NEGATIVES, ROUNDS, WORST = 192, 5000, 5, 3
#: Disguised forms of each toxic string in training, and what each counts against the string itself.
DISGUISES, DISGUISE_WEIGHT = 3, 0.1
#: What all clean strings count in training against all toxic ones.
CLEAN_WEIGHT = 4.0
#: How far from chance (as a G statistic, halved) a landmark's share of toxic documents has to be.
EVIDENCE = 10.0
FIELDS = T.StructType([T.StructField("score", T.DoubleType())])
#: Where the second, third and fourth letter of a subsequence stand after the first.
STEPS = [(d, e, f) for f in range(3, REACH + 1) for e in range(2, f) for d in range(1, e)]
#: Signs that are read as letters: fixed values.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Letters of their own, not marked forms of others: fixed values.
OWN_LETTERS = "ñçß"
BLANK = 255
#: Where a sentence ends.
SENTENCE_END = re.compile(r"[.!?。！？]+(?=\s)|[\n\r\u2028\u2029]")
#: Characters that are worked on together.
AT_ONCE = 1 << 18


@dataclass
class KernelMachine:
    sequences: np.ndarray  # weight of each subsequence
    offset: float
    slopes: np.ndarray  # of the logistic fit, for the WORST largest values
    height: float


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Letter (1 to 27), 0 (a sign, left out) or BLANK of each code point."""
    codes = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            base = ch if ch.lower() in OWN_LETTERS else unicodedata.normalize("NFD", ch)[0].lower()
            codes[c] = ord(base) - 96 if "a" <= base <= "z" else LETTERS - 1
        elif ch.isspace():
            codes[c] = BLANK
    for sign, letter in LOOKALIKES.items():
        codes[ord(sign)] = ord(letter) - 96
    return codes


def _norms() -> np.ndarray:
    """Root of the kernel of a string of n different letters with itself."""
    n = np.arange(LONGEST + 3)
    return np.sqrt(np.maximum(sum(np.maximum(n - f, 0) * DECAY ** (2 * f) for *_, f in STEPS), DECAY**6))


def _coded(text: str | None) -> np.ndarray:
    return _codes()[np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")]


def _begins(runs: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, runs[1:] != runs[:-1])) if len(runs) else np.empty(0, np.int64)


def _strings(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings in a text's codes: places of their letters, and each letter's string by number."""
    codes = np.concatenate([[BLANK, BLANK], codes, [BLANK, BLANK]]).astype(np.uint8)
    blank = codes == BLANK
    alone, joins = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    alone[1:-1] = ~blank[1:-1] & blank[:-2] & blank[2:]
    joins[1:-1] = blank[1:-1] & alone[:-2] & alone[2:]  # the blank between two letters that stand alone
    letter = ~blank & (codes > 0)
    place, unit = np.flatnonzero(letter) - 2, np.cumsum(blank & ~joins)[letter]
    if not len(unit):
        return place, unit
    first = _begins(unit)
    sizes = np.diff(np.append(first, len(unit)))
    number = np.repeat(np.arange(len(sizes)), sizes)
    if sizes.max() <= LONGEST:
        return place, number
    # Long strings: halves of a piece are numbered; each but the first also ends the piece before it.
    half = LONGEST // 2
    lone = sizes[number] <= LONGEST
    inside = np.where(lone, 0, (np.arange(len(unit)) - first[number]) // half)
    key = np.append(0, np.cumsum(-(-sizes // half)))[:-1][number] + inside
    again = inside > 0
    at, keys = np.append(np.arange(len(unit)), np.flatnonzero(again)), np.append(key, key[again] - 1)
    order = np.lexsort((at, keys))
    return place[at[order]], keys[order]


def _edged(letters: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings with their edges, a 0 before and after each."""
    first = _begins(unit)
    ends = np.append(first[1:], len(unit)) if len(first) else first
    at = np.concatenate([first, ends])
    numbers = np.concatenate([unit[first], unit[ends - 1]]) if len(first) else np.empty(0, np.int64)
    order = np.lexsort((np.append(np.ones(len(first)), np.zeros(len(ends))), at))
    return np.insert(letters, at[order], 0), np.insert(unit, at[order], numbers[order])


def _sequences(letters: np.ndarray, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each step: places where a subsequence begins, its index, its weight."""
    out, c = [], letters.astype(np.int32)
    pairs = {d: c[:-d] * LETTERS + c[d:] for d in range(1, REACH)}
    for reach in range(3, REACH + 1):
        at = np.flatnonzero(unit[:-reach] == unit[reach:])
        for d, e, f in STEPS:
            if f == reach and len(at):
                out.append((at, pairs[d][at] * LETTERS**2 + pairs[f - e][at + e], DECAY**f))
    return out


def values(machine: KernelMachine, letters: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value of each string, and the string's number."""
    if not len(letters):
        return np.empty(0), np.empty(0, np.int64)
    letters, unit = _edged(letters, unit)
    at_letter = np.zeros(len(letters))
    for at, index, weight in _sequences(letters, unit):
        at_letter[at] += weight * machine.sequences[index]
    first = _begins(unit)
    size = np.diff(np.append(first, len(unit)))
    return np.add.reduceat(at_letter, first) / _norms()[np.minimum(size, LONGEST + 2)] + machine.offset, unit[first]


def _joined(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*strings, np.empty(0, np.uint8)]), np.repeat(np.arange(len(strings)), [len(c) for c in strings])


@dataclass
class _Landmarks:
    """The subsequences that landmarks hold, and how much of each is in which."""

    place: np.ndarray  # row of a subsequence below; the last row for those in no landmark
    share: np.ndarray  # subsequence by landmark, normed

    @classmethod
    def of(cls, strings: list[np.ndarray]) -> _Landmarks:
        letters, unit = _edged(*_joined(strings))
        steps = _sequences(letters, unit)
        held = np.unique(np.concatenate([index for _, index, _ in steps]))
        place = np.full(SEQUENCES, len(held), np.int32)
        place[held] = np.arange(len(held))
        share = np.zeros((len(held) + 1, len(strings)), np.float32)
        for at, index, weight in steps:
            np.add.at(share, (place[index], unit[at]), np.float32(weight))
        return cls(place, share / _norms()[np.minimum(np.bincount(unit, minlength=len(strings)), LONGEST + 2)].astype(np.float32))

    def kernel(self, strings: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(strings), self.share.shape[1]), np.float32)
        for k in range(0, len(strings), 1024):
            letters, unit = _edged(*_joined(strings[k : k + 1024]))
            at_letter = np.zeros((len(letters), out.shape[1]), np.float32)
            for at, index, weight in _sequences(letters, unit):
                row = self.place[index]
                some = row < len(self.share) - 1
                at_letter[at[some]] += np.float32(weight) * self.share[row[some]]
            first = _begins(unit)
            size = np.diff(np.append(first, len(unit)))
            out[k + unit[first]] = np.add.reduceat(at_letter, first) / _norms()[np.minimum(size, LONGEST + 2)].astype(np.float32)[:, None]
        return out

    def fold(self, alpha: np.ndarray) -> np.ndarray:
        return (self.share @ alpha)[self.place].astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine by squared hinge loss: Newton steps on the rows that fall short."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight, w = weight / weight.sum(), np.zeros(x.shape[1])
    for _ in range(30):
        short = y * (x @ w) < 1
        own = x[short] * weight[short, None]
        new = np.linalg.solve(own.T @ x[short] + strength * np.eye(x.shape[1]), own.T @ y[short])
        if np.allclose(new, w, atol=1e-6):
            break
        w = w + 0.7 * (new - w)
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge, weight = np.zeros(x.shape[1]), 1e-3 * np.append(np.ones(x.shape[1] - 1), 0), weight / weight.sum()
    for _ in range(60):  # Newton, in steps that are held back
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = weight * np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (weight * (p - y)) + ridge * w)
        w -= step * min(1, 2 / max(1e-9, np.abs(step).max()))
    return w[:-1], float(w[-1])


class _Sentences:
    """The sentences of the training texts. Distinct strings are kept once, and sentences are runs of their numbers."""

    def __init__(self, texts: list[str], y: np.ndarray) -> None:
        letters, names, sentences, docs = [], [], [], []
        powers = np.cumprod(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64))
        last = 0
        for doc, text in enumerate(texts):
            codes = _coded(text)
            place, unit = _strings(codes)
            first = _begins(unit)
            if not len(first):
                continue
            own = codes[place]
            letters += np.split(own, first[1:])
            names.append(np.add.reduceat(own * powers[np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))], first))
            ends = np.array([m.start() for m in SENTENCE_END.finditer(text)], np.int64)
            sentences.append(last + np.maximum.accumulate(np.searchsorted(ends, place[first])))
            docs.append(np.full(len(first), doc))
            last = sentences[-1][-1] + 1
        _, one, self.string = np.unique(np.concatenate([*names, np.empty(0, np.uint64)]), return_index=True, return_inverse=True)
        self.distinct = [letters[i] for i in one]
        of_string, doc = np.concatenate([*sentences, np.empty(0, np.int64)]), np.concatenate([*docs, np.empty(0, np.int64)])
        self.first = _begins(of_string)
        self.sentence = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(of_string))))
        self.doc = doc[self.first]
        self.toxic = y[self.doc] == 1
        self.in_toxic, self.in_clean = (self._held(doc[y[doc] == label], y[doc] == label) for label in (1, 0))
        clean = ~self.toxic[self.sentence]
        self.clean = self._held(self.sentence[clean], clean)

    def _held(self, by: np.ndarray, at: np.ndarray) -> np.ndarray:
        """In how many documents or sentences each distinct string is."""
        pairs = np.unique(self.string[at].astype(np.int64) << 32 | by)
        return np.bincount(pairs >> 32, minlength=len(self.distinct))

    def evidence(self, share: float) -> np.ndarray:
        """How far beyond EVIDENCE each distinct string's share of toxic documents is above chance; below 0 for all others."""
        n, others, long = self.in_toxic, self.in_clean, np.array([len(s) >= 3 for s in self.distinct], bool)
        own = n / np.maximum(1, n + others)
        evidence = n * np.log(np.maximum(own, 1e-12) / share) + others * np.log(np.maximum(1 - own, 1e-12) / (1 - share))
        return np.where(long & (n >= 3) & (own > share) & (evidence > EVIDENCE), evidence, -1.0 - others)

    def worst(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each sentence the worst string and its value, by the values of the distinct strings."""
        own = value[self.string]
        top = np.maximum.reduceat(own, self.first)
        at = np.flatnonzero(own == top[self.sentence])
        return self.string[at[_begins(self.sentence[at])]], top


def train(texts: list[str], y: np.ndarray, weights: np.ndarray) -> KernelMachine:
    nothing = KernelMachine(np.zeros(SEQUENCES), 0.0, np.zeros(WORST), -500.0)
    if len(set(y.tolist())) < 2:
        return nothing if not len(y) or y[0] == 0 else KernelMachine(np.zeros(SEQUENCES), 0.0, np.zeros(WORST), 500.0)
    sentences = _Sentences(texts, y)
    of_string = sentences.evidence(float((y == 1).mean()))
    marks = np.flatnonzero(of_string > 0)
    marks = marks[np.argsort(-sentences.in_toxic[marks], kind="stable")]
    usual = np.flatnonzero(sentences.clean)
    usual = usual[np.argsort(-sentences.clean[usual], kind="stable")]
    if not len(marks) or not len(usual):
        return nothing
    strings = lambda numbers: [sentences.distinct[i] for i in numbers]
    landmarks = strings([*marks[:LANDMARKS], *usual[:LANDMARKS]])
    held = _Landmarks.of(landmarks)
    gram = held.kernel(landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    rng, every = np.random.default_rng(11), _joined(sentences.distinct)
    negatives = np.union1d(usual[:LANDMARKS], usual[:: max(1, len(usual) // NEGATIVES)][:NEGATIVES])
    for _ in range(ROUNDS):
        worst, top = sentences.worst(of_string)
        positives, often = np.unique(worst[sentences.toxic & (top > 0)], return_counts=True)
        if not len(positives):
            break
        # Disguised forms, with one letter put in, count a little in training.
        disguised = [np.insert(s, i, rng.integers(1, LETTERS - 1))[:LONGEST] for s in strings(positives) for i in rng.integers(1, max(2, len(s)), DISGUISES)]
        mistaken = np.unique(worst[~sentences.toxic])
        mistaken = mistaken[np.argsort(-of_string[mistaken], kind="stable")][: NEGATIVES // 6]
        negatives = np.union1d(negatives, mistaken)
        x = held.kernel([*strings(positives), *disguised, *strings(negatives)]) @ root
        side = np.where(np.arange(len(x)) < len(positives) + len(disguised), 1.0, -1.0)
        weight = np.concatenate([often, np.repeat(DISGUISE_WEIGHT * often, DISGUISES), np.minimum(sentences.clean[negatives], 50)])
        for of in (side > 0, side < 0):
            weight[of] *= (1.0 if side[of][0] > 0 else CLEAN_WEIGHT) / weight[of].sum()
        w, offset = _svm(x, side, weight)
        machine = KernelMachine(held.fold(root @ w), offset, np.zeros(WORST), 0.0)
        of_string, _ = values(machine, *every)
    machine.slopes, machine.height = _logistic(_clipped(machine, texts), y, weights)
    return machine


def worst_values(machine: KernelMachine, texts: list[str | None]) -> np.ndarray:
    """The WORST largest values of each text's strings, in order; the machine's offset where there are fewer."""
    out = np.full((len(texts), WORST), machine.offset)
    gap = np.full(2, BLANK, np.uint8)
    i = 0
    while i < len(texts):
        codes, sizes, begin = [], [], i
        while i < len(texts) and sum(sizes) < AT_ONCE:
            own = _coded(texts[i])
            codes += [own, gap]
            sizes.append(len(own) + 2)
            i += 1
        joined = np.concatenate(codes)
        place, unit = _strings(joined)
        if len(place):
            got, number = values(machine, joined[place], unit)
            first = _begins(unit)
            doc = np.repeat(np.arange(begin, i), sizes)[place[first]]
            order = np.lexsort((-got, doc))
            doc, got = doc[order], got[order]
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
            top = rank < WORST
            out[doc[top], rank[top]] = got[top]
    return out


def _clipped(machine: KernelMachine, texts: list[str | None]) -> np.ndarray:
    """Beyond the margin all values count alike."""
    return np.clip(worst_values(machine, texts), -1, 1)


def toxicity(docs: DataFrame, machine: KernelMachine, text: str = "text") -> DataFrame:
    """Each document packed as `row`, with its score."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(texts: pa.Array) -> list[pa.Array]:
        model = shared.value
        z = _clipped(model, texts.to_pylist()) @ model.slopes + model.height
        return [pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))]

    return scored(docs, text, score, FIELDS)

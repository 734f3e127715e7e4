"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language (LEARN_DOCS documents of the smallest hashes, each
with its first DOC_CHARS characters, LEARN_CHARS symbols in all) becomes a suffix automaton. A text is
parsed greedily against each: the longest match is one phrase, then the next begins. The language
whose automaton needs the fewest phrases, each weighed by the log of its sample's length, wins; of
equals the first by name. Whole texts are parsed, in lanes of LANE symbols that numpy advances side
by side; a worker holds one table of states by symbols, written in place, and the texts of one
portion, however long a single text is.

Symbols are lower-cased letters; a run of anything else is one blank. Up to SINGLES different letters of all samples are a code each. Scripts of more
have a code each for the COMMON most frequent letters, and two or three codes, like the bytes of UTF-8, for the others: some sixteen thousand
letters stay apart in tables of SYMBOLS columns. A letter that no sample has is a code that no automaton goes on with. A text that is null or has
no letter is `und` with score 0. If no row can be learned from, every text is. Rows with a null
language or a null id are not learned from. Of rows that share an id and a language one text is learned from, the
first in order. Repeated rows are judged alike; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import uuid
from array import array
from dataclasses import dataclass
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, scored, smallest_by_hash

LEARN_DOCS, LEARN_CHARS, DOC_CHARS = 150, 40_000, 2_000
LANE, SYMBOLS = 512, 64
#: Letters of one code: all of them, if there are no more than this, or else the most frequent. Codes that begin a pair, and a triple.
SINGLES, COMMON, PAIRS, TRIPLES = SYMBOLS - 2, 40, 18, 4
#: Lanes that are advanced side by side, and rows of a table that are filled at once.
AT_ONCE = 8192
UNDETERMINED = "und"
FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
#: How sharply a difference of one bit a symbol counts in the score.
SHARPNESS = 6.0


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order of name, and the text that each is known by."""

    languages: tuple[str, ...]
    samples: tuple[str, ...]


def learn(docs: DataFrame, learnable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    rows = docs.where(learnable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.substring(F.col(text), 1, DOC_CHARS).alias("text"))
    chosen = smallest_by_hash(rows.select("lang", "doc_id"), "lang", "doc_id", LEARN_DOCS)
    # One text of at most DOC_CHARS for each of LEARN_DOCS ids a language, however often an id repeats.
    texts = rows.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    by_lang: dict[str, list[str]] = {}
    for row in sorted(texts.collect(), key=lambda r: (r["lang"], r["doc_id"])):
        by_lang.setdefault(row["lang"], []).append(row["text"])
    joined = {k: " ".join(v)[:LEARN_CHARS] for k, v in by_lang.items()}
    names = sorted(k for k, v in joined.items() if any(c.isalpha() for c in v))
    return LanguageModel(tuple(names), tuple(joined[k] for k in names))


def _codes(letters: list[str]) -> dict[str, tuple[int, ...]]:
    """Codes of letters that come by frequency; 0 is no letter, 1 a letter not in the samples. Letters beyond the last triple are left out."""
    if len(letters) <= SINGLES:
        return {c: (i,) for i, c in enumerate(letters, 2)}
    trail, pair = range(2, SYMBOLS), range(2 + COMMON, 2 + COMMON + PAIRS)
    triple = range(pair.stop, pair.stop + TRIPLES)
    codes = chain(((i,) for i in range(2, 2 + COMMON)), product(pair, trail), product(triple, trail, trail))
    return dict(zip(letters, codes, strict=False))


def _symbols(text: str, code: np.ndarray) -> np.ndarray:
    """Codes of the text's letters, a 0 for each run of others."""
    codes = code[:, np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    keep = codes != 0
    keep[0, 1:] |= codes[0, :-1] != 0
    return codes.T[keep.T]


def _automaton(symbols: list[int], table: np.ndarray, first: int) -> int:
    """Writes the suffix automaton's transitions, state by symbol, into the rows of `table` from `first`
    on (they are zero before), and returns how many states it has.

    States are numbered by row. Where there is no transition, the root's own for the symbol stands in, as its
    complement: a new phrase begins there.
    """
    cells, width = memoryview(table.ravel()), table.shape[1]
    link, length = array("i", [-1]), array("i", [0])  # by state, counted from `first`
    last = 0
    for c in symbols:
        current = len(length)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and not cells[(at := (first + p) * width + c)]:
            cells[at] = first + current
            p = link[p]
        if p != -1:
            q = cells[(first + p) * width + c] - first
            if length[q] == length[p] + 1:
                link[current] = q
            else:
                clone = len(length)
                table[first + clone] = table[first + q]
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and cells[(at := (first + p) * width + c)] == first + q:
                    cells[at] = first + clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    root = ~np.where(table[first] > 0, table[first], first)
    for k in range(first, first + len(length), AT_ONCE):
        part = table[k : min(k + AT_ONCE, first + len(length))]
        np.copyto(part, root, where=part == 0)
    return len(length)


class _Parser:
    def __init__(self, model: LanguageModel) -> None:
        seen: dict[str, int] = {}
        for c in "".join(model.samples).lower():
            if c.isalpha():
                seen[c] = seen.get(c, 0) + 1
        place = _codes(sorted(seen, key=lambda c: (-seen[c], c)))
        # Row k has the k-th code of each letter, if it has so many.
        self.code = np.zeros((max(map(len, place.values()), default=1), 0x110000), np.uint8)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                own = place.get(c.lower()[0], (1,))
                self.code[: len(own), ord(c)] = own
        symbols = [_symbols(s, self.code)[:LEARN_CHARS] for s in model.samples]
        self.bits = np.log2([max(2, len(s)) for s in symbols])
        # One table for all; an automaton of n symbols has at most 2 n + 1 states. State 0 is nobody's, so that
        # no transition is 0; rows that are never written take no memory.
        room = [2 * len(s) + 2 for s in symbols]
        self.first = (1 + np.cumsum([0, *room[:-1]])).astype(np.int32)
        self.width = min(len(place) + 2, SYMBOLS)
        table = np.zeros((1 + sum(room), self.width), np.int32)
        for s, first in zip(symbols, self.first.tolist()):
            _automaton(s.tolist(), table, first)
        self.table = table.ravel()
        self.languages = np.array(model.languages)

    def phrases(self, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each language and lane; lanes are in descending order of length."""
        state = np.repeat(self.first[:, None], len(lanes), 1)
        count = np.zeros(state.shape, np.int32)
        live = np.searchsorted(-lengths, -np.arange(lanes.shape[1]), "left")  # lanes longer than j
        columns = np.ascontiguousarray(lanes.T)
        for j in range(lanes.shape[1]):
            n = live[j]
            to = self.table[state[:, :n] * self.width + columns[j, :n]]
            count[:, :n] += to < 0
            state[:, :n] = to ^ (to >> 31)
        return count + 1

    def judge(self, texts: pa.Array) -> list[pa.Array]:
        own = [_symbols(t, self.code) if t else np.empty(0, np.uint8) for t in texts.to_pylist()]
        langs, scores = np.full(len(own), UNDETERMINED, object), np.zeros(len(own))
        lettered = [i for i, s in enumerate(own) if s.any()]
        if lettered and len(self.languages):
            pieces, of = [], []
            for i in lettered:
                for k in range(0, len(own[i]), LANE):
                    pieces.append(own[i][k : k + LANE])
                    of.append(i)
            lengths = np.array([len(p) for p in pieces])
            order, of_doc = np.argsort(-lengths, kind="stable"), np.array(of)
            total = np.zeros((len(self.languages), len(own)))
            for k in range(0, len(order), AT_ONCE):
                some = order[k : k + AT_ONCE]
                lanes = np.zeros((len(some), LANE), np.uint8)
                for row, p in enumerate(some):
                    lanes[row, : lengths[p]] = pieces[p]
                for lang, counts in enumerate(self.phrases(lanes, lengths[some])):
                    total[lang] += np.bincount(of_doc[some], counts, len(own))
            n = np.array([max(1, len(s)) for s in own])
            entropy = total * self.bits[:, None] / n
            best = entropy.argmin(0)
            weight = np.exp(-SHARPNESS * (entropy - entropy.min(0)))
            share = 1 / weight.sum(0)
            langs[lettered], scores[lettered] = self.languages[best[lettered]], share[lettered]
        return [pa.array(langs.tolist(), pa.string()), pa.array(scores)]


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Each document packed as `row`, with lang_pred and score."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), f"language {uuid.uuid4().hex}"
    return scored(docs, text, lambda texts: kept(name, lambda: _Parser(shared.value)).judge(texts), FIELDS)

"""Benchmark decontamination by Wu-Manber search for many strings at once.

The strings are windows: each run of `n` words of a benchmark item, or the whole item if it has fewer. Words
are lower-cased (A-Z only) and compared by their bytes. For the windows of one length in words there is

- a shift table: for each block of two words (by hash), how many words an occurrence can end later at the least;
  most blocks occur in no window, and let the search skip all but one of the window's words;
- buckets of windows by their last block, told apart by their first block too;
- direct comparison of the window's words with the text's, byte by byte.

All texts of a portion are searched side by side: each step looks at one place of every text (of every stretch of a long
one) and moves it on by the table. Windows are broadcast in groups of at most about `at_once`, which bounds the
tables; more windows take more passes over the documents, which are then written once with a number for each row.

A null text has no words. A null item id counts as the empty text. Items that share an id are one item; rows of documents that share an id
stay apart. Texts without words, empty items and empty tables are hit by nothing. Other columns of the documents, whatever
their names, are packed as `row` and carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import portions, settled, text_batches
from .words import FOLDED, hashes, mixed, pieces, raw, spans

#: Bits of a block's hash that number its place in the shift table.
TABLE_BITS = 20
#: Ends of windows that one lane of the search goes through.
LANE = 2048
#: Bytes of text that are cut into words at once.
STRETCH = 1 << 20

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def windows(items: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Each item's different windows: item (its id as text) and window (words with single spaces)."""
    names = items.columns
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("window", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), raw(batch.column(1)).to_pylist(), strict=True):
                words = [w for piece in pieces(data or b"") for w in piece]
                found = list({b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}) if words else []
                for low in range(0, len(found), 10_000):
                    part = found[low : low + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], names=["item", "window"])

    assert {item_id, text} <= set(names)
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return text_batches(rows).mapInArrow(cut, schema).distinct()


class Tables:
    """The search's tables for windows of one length in words."""

    def __init__(self, size: int, texts: list[bytes], items: list[list[str]]):
        self.size, self.texts, self.items = size, texts, items
        data = np.frombuffer(b" ".join(texts), np.uint8)
        starts, ends = spans(data, np.array([0, len(data)]))
        words = hashes(data, starts, ends).reshape(len(texts), size)
        self.block = min(2, size)
        self.shift = np.full(1 << TABLE_BITS, size - self.block + 1, np.int8 if size < 100 else np.int64)
        for last in range(self.block - 1, size):
            np.minimum.at(self.shift, self._place(words, last), size - 1 - last)
        keys = self._bucket(words, size - 1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.order, self.words = keys[order], order, words

    def _hash(self, words: np.ndarray, last: np.ndarray | int) -> np.ndarray:
        """The hash of the block that ends with the word at `last`."""
        at = words[..., last]
        return mixed(at if self.block == 1 else at * np.uint64(3) + words[..., last - 1])

    def _place(self, words: np.ndarray, last: np.ndarray | int) -> np.ndarray:
        return (self._hash(words, last) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _bucket(self, words: np.ndarray, last: np.ndarray | int) -> np.ndarray:
        return self._hash(words, last) * np.uint64(5) + self._hash(words, last - self.size + self.block)

    def occurrences(self, words: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of last words, and the windows that may end there, of texts whose words begin at `firsts`; still to be compared."""
        ends = np.maximum(counts - self.size + 1, 0)  # how many windows of this size a text has room for
        lanes = -(-ends // LANE)
        text = np.repeat(np.arange(len(firsts)), lanes)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = firsts[text] + self.size - 1 + turn * LANE
        stop = np.minimum(at + LANE, firsts[text] + counts[text])
        while len(at):
            ahead = self.shift[self._place(words, at)]
            stops = at[ahead == 0]
            if len(stops):
                key = self._bucket(words, stops)
                low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
                n = high - low
                where = np.repeat(stops, n)
                nth = np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
                which = self.order[np.repeat(low, n) + nth]
                same = np.ones(len(where), bool)
                for i in range(self.size):
                    same &= words[where - i] == self.words[which, self.size - 1 - i]
                yield where[same], which[same]
            at = at + np.maximum(ahead, 1)
            on = at < stop
            at, stop = at[on], stop[on]


def tables(pairs: list[tuple[str, bytes]]) -> list[Tables]:
    """The tables of (item, window) pairs, one for each length in words."""
    of: dict[bytes, list[str]] = {}
    for item, window in pairs:
        of.setdefault(window, []).append(item)
    sizes: dict[int, list[bytes]] = {}
    for window in sorted(of):
        sizes.setdefault(window.count(b" ") + 1, []).append(window)
    return [Tables(size, found, [sorted(of[w]) for w in found]) for size, found in sorted(sizes.items())]


def _folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of a portion's texts one after another, and the edges between them."""
    each = [t or b"" for t in texts.to_pylist()]
    edges = np.concatenate(([0], np.cumsum([len(t) for t in each], dtype=np.int64)))
    return np.frombuffer(b"".join(each).translate(FOLDED), np.uint8), edges


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, hashed a stretch at a time."""
    starts, ends = spans(data, edges)
    cuts = np.searchsorted(starts, np.arange(STRETCH, len(data), STRETCH))
    parts = [hashes(data, s, e) for s, e in zip(np.split(starts, cuts), np.split(ends, cuts), strict=True)]
    return starts, ends, np.concatenate(parts) if parts else np.empty(0, np.uint64)


def search(texts: pa.Array, searched: list[Tables]) -> list[pa.Array]:
    """For each text its number of words, the merged stretches of words [start, end) that windows cover, and the items they are of."""
    data, edges = _folded(raw(texts))
    starts, ends, words = _words(data, edges)
    firsts = np.searchsorted(starts, edges)
    counts = np.diff(firsts)
    firsts = firsts[:-1]
    steps = np.zeros(len(words) + 1, np.int64)
    items: list[set[str]] = [set() for _ in counts]
    for t in searched:
        for last, window in t.occurrences(words, firsts, counts):
            first = last - t.size + 1
            text = np.searchsorted(firsts, first, "right") - 1
            for a, b, w, i in zip(first.tolist(), last.tolist(), window.tolist(), text.tolist(), strict=True):
                if b" ".join(data[s:e].tobytes() for s, e in zip(starts[a : b + 1], ends[a : b + 1], strict=True)) == t.texts[w]:
                    steps[a] += 1
                    steps[b + 1] -= 1
                    items[i].update(t.items[w])
    covered = np.concatenate((np.cumsum(steps[:-1]) > 0, [False]))
    begin = covered[:-1].copy()
    begin[1:] &= ~covered[:-2]
    begin[firsts[counts > 0]] = covered[firsts[counts > 0]]
    end = covered[:-1] & ~covered[1:]
    last = (firsts + counts - 1)[counts > 0]
    end[last] = covered[last]
    low, high = np.flatnonzero(begin), np.flatnonzero(end) + 1
    text = np.searchsorted(firsts + counts, low, "right")
    hits: list[list[dict]] = [[] for _ in counts]
    for i, a, b in zip(text.tolist(), (low - firsts[text]).tolist(), (high - firsts[text]).tolist(), strict=True):
        hits[i].append({"start": a, "end": b})
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [pa.array(counts, pa.int64()), pa.array(hits, spans_type), pa.array([sorted(s) for s in items], pa.list_(pa.string()))]


def _pass(docs: DataFrame, text: str, searched: list[Tables]) -> DataFrame:
    """Each row, packed as `row`, with what one group of windows finds in it."""
    at = docs.columns.index(text)
    schema = T.StructType([T.StructField("row", docs.schema), *FOUND.fields])
    sent = docs.sparkSession.sparkContext.broadcast(searched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, lambda b: b.column(0).field(at), STRETCH):
            row = batch.column(0)
            yield pa.RecordBatch.from_arrays([row, *search(row.field(at), sent.value)], names=schema.names)

    return text_batches(docs.select(F.struct("*").alias("row"))).mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", at_once: int = 200_000) -> DataFrame:
    """Each document, packed as `row`, with n_words, hits (merged stretches of its words [start, end), from 0) and items (ids as text, sorted)."""
    pairs = settled(windows(items, n, item_id, item_text), "windows")
    groups = max(1, -(-pairs.count() // at_once))
    group = F.pmod(F.xxhash64("item", "window"), F.lit(groups))
    chosen = lambda g: tables([(r["item"], bytes(r["window"])) for r in pairs.where(group == g).collect()])
    if groups == 1:
        return _pass(docs, text, chosen(0))
    kept = settled(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("at"), F.col(text).alias("text")), "documents")
    found = None
    for g in range(groups):
        one = settled(_pass(kept.select("at", "text"), "text", chosen(g)).select("row.at", *FOUND.names), "found")
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("at").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    meets = lambda acc, x: (F.size(acc) > 0) & (last(acc)["end"] >= x["start"])
    longer = lambda acc, x: F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))
    joined = F.aggregate(
        "hits", F.array().cast(FOUND["hits"].dataType),
        lambda acc, x: F.when(meets(acc, x), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer(acc, x)))).otherwise(F.concat(acc, F.array(x))),
    )
    return kept.join(merged.withColumn("hits", joined), "at").select(F.col("doc").alias("row"), *FOUND.names)


def n_hit(hits: str = "hits") -> Column:
    """How many words the stretches have."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])


def without_contaminated(docs: DataFrame, items: DataFrame, most: float = 0.0, **options: object) -> DataFrame:
    """The documents of whose words at most the share `most` is hit, with their own columns."""
    return contamination(docs, items, **options).where(n_hit() <= most * F.col("n_words")).select("row.*")

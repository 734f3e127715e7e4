"""Spelling variants: words that differ from a far more frequent one by one letter.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced letter makes one from the other. Near words are found by
Bloom-guided neighbourhoods: the vocabulary's Bloom filters, one for each length of word, are broadcast; every word's
edits (its deletions, and its replacements by a later letter: so each pair once) are generated and probed as hashes, and only edits that
a filter may hold become text, shuffle, and meet the vocabulary in an exact join that removes false positives.

A filter is made of segments of 4 KB, each of blocks of 512 bits; a word sets K bits in one block. A length has as many segments
as its words need at BITS bits a word. Segments are broadcast `at_once` (32 MB) at a time; a larger vocabulary
takes more rounds, each over the words whose lengths or next lengths are in it, with the same result.

Letters are a-z and U+00C0 to U+00FF (after A-Z are lower-cased; others keep their case); a word is a maximal run of them. A null
text has no words; a null id counts as empty. Rows that repeat count as often as they stand. Empty tables give no words.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, settled, text_batches
from .words import mixed, raw

#: In UTF-8: a-z, and U+00C0 to U+00FF.
RUN = re.compile("[a-zÀ-ÿ]+")
BITS, K = 24, 5
SEGMENT_BITS, BLOCK_BITS = 32768, 512
#: Segments of 4 KB that are broadcast at once.
AT_ONCE = 8192
#: Edits of which hashes are made at once.
SLAB = 1 << 20
#: Different words that a task counts before it passes them on.
COUNTED = 200_000

_BASE = 0x9E3779B97F4A7C15


def _pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in pieces of about `size` characters that cut no word."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            end = RUN.match(text, end).end() if RUN.match(text, end) else end
        yield text[at:end]
        at = end


def word_counts(docs: DataFrame, shortest: int = 1, slips: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n, over all texts, of words of at least `shortest` letters.

    With `slips`, a word of a document loses a letter where `slips` divides h, the crc32 of "<doc_id>:<word>": its letter h % length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in portions(batches, lambda b: b.column(1)):
            for key, data in zip(batch.column(0).to_pylist(), raw(batch.column(1)).to_pylist(), strict=True):
                prefix = crc32(f"{key}:".encode())
                for piece in _pieces((data or b"").lower().decode()):  # bytes' lower() is that of A-Z alone
                    for word, n in Counter(RUN.findall(piece)).items():
                        if len(word) >= shortest:
                            if slips and (h := crc32(word.encode(), prefix)) % slips == 0:
                                word = word[: h % len(word)] + word[h % len(word) + 1 :]
                                if len(word) < max(1, shortest):
                                    continue
                            counts[word] += n
                    if len(counts) >= COUNTED:
                        yield passed_on()
        if counts:
            yield passed_on()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    return text_batches(rows).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words of one length: the length, their places in the list, and their letters' codes as a matrix."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        codes = np.frombuffer("".join(words[i] for i in at).encode("latin-1"), np.uint8)
        yield int(size), at, codes.reshape(len(at), size)


def _powers(n: int) -> np.ndarray:
    factors = np.full(n, _BASE, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def _sums(codes: np.ndarray) -> np.ndarray:
    """Sums of code times power up to each letter, modulo 2^64; the last is the word's hash before its bits are spread."""
    return np.cumsum(codes.astype(np.uint64) * _powers(codes.shape[1]), axis=1, dtype=np.uint64)


def _segment(x: np.ndarray, segments: int) -> np.ndarray:
    return (((x >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)


def _bits(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th bit of a hash in its segment."""
    block = (x & np.uint64(SEGMENT_BITS // BLOCK_BITS - 1)).astype(np.int64)
    inside = ((x * np.uint64(_BASE)) >> np.uint64(9 * k + 16)) & np.uint64(BLOCK_BITS - 1)
    return block * BLOCK_BITS + inside.astype(np.int64)


class Filters:
    """One round's segments: those numbered from `low` on, of all that the lengths have (`first` and `segments` of each length)."""

    def __init__(self, first: dict[int, int], segments: dict[int, int], low: int, bitmaps: list[bytes]):
        self.first, self.segments, self.low, self.n = first, segments, low, len(bitmaps)
        self.words = np.frombuffer(b"".join(bitmaps), np.uint8)

    def may_have(self, size: int, x: np.ndarray) -> np.ndarray:
        """The places of the hashes (spread) that a word of this length in this round may have."""
        if size not in self.segments:
            return np.empty(0, np.int64)
        at = _segment(x, self.segments[size]) + (self.first[size] - self.low)
        left = np.flatnonzero((at >= 0) & (at < self.n))
        x, at = x[left], at[left] * (SEGMENT_BITS // 8)
        for k in range(K):
            bit = _bits(x, k)
            on = (self.words[at + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1
            left, x, at = left[on], x[on], at[on]
        return left


def edits(codes: np.ndarray, letters: np.ndarray, filters: Filters) -> Iterator[tuple[int, str]]:
    """(row, edit) of words of one length: deletions, and replacements by a later letter, that the filters may hold."""
    n, size = codes.shape
    sums, powers = _sums(codes), _powers(size)
    back = np.uint64(pow(_BASE, -1, 1 << 64))
    before = np.concatenate((np.zeros((n, 1), np.uint64), sums[:, :-1]), axis=1)
    fresh = np.ones((n, size), bool)  # of equal letters in a row only the first is deleted
    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
    step = max(1, SLAB // (max(1, n) * len(letters)))
    text = lambda row, at, put: bytes(np.concatenate((codes[row, :at], put, codes[row, at + 1 :]))).decode("latin-1")
    for low in range(0, size, step):
        part = codes[:, low : low + step]
        shorter = before[:, low : low + step] + (sums[:, -1:] - sums[:, low : low + step]) * back
        rows, places = np.nonzero(fresh[:, low : low + step])
        for i in filters.may_have(size - 1, mixed(shorter[rows, places])):
            yield rows[i], text(rows[i], low + places[i], codes[0, :0])
        ahead = letters.astype(np.uint64) - part[:, :, None].astype(np.uint64)
        rows, places, which = np.nonzero(letters > part[:, :, None])
        x = mixed(sums[rows, -1] + ahead[rows, places, which] * powers[low + places])
        for i in filters.may_have(size, x):
            yield rows[i], text(rows[i], low + places[i], letters[which[i] : which[i] + 1])


def _filters(words: DataFrame, segments: dict[int, int], first: dict[int, int]) -> DataFrame:
    """number (of the segment among all) and its bitmap; words are dealt by segment, so no task has more than its segments' words."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, codes in _by_length(batch.column(0).to_pylist()):
                x = mixed(_sums(codes)[:, -1])
                number = np.repeat(_segment(x, segments[size]) + first[size], K)
                bits = np.stack([_bits(x, k) for k in range(K)], axis=1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(bits, pa.int64())], names=["number", "bit"])

    placed = words.select("word").mapInArrow(place, "number long, bit long")
    return placed.repartition("number").groupBy("number").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def _probed(words: DataFrame, letters: np.ndarray, filters: Filters) -> DataFrame:
    """word, n and an edit of it that the filters may hold."""
    sent = words.sparkSession.sparkContext.broadcast(filters)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for size, at, codes in _by_length(words):
                rows = max(1, SLAB // (size * len(letters)))
                for low in range(0, len(at), rows):
                    found = [(at[low + row], edit) for row, edit in edits(codes[low : low + rows], letters, sent.value)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[i] for i, _ in found], pa.string()), pa.array([n[i] for i, _ in found], pa.int64()), pa.array([e for _, e in found], pa.string())], names=["word", "n", "edit"]
                    )

    return words.select("word", "n").mapInArrow(probe, "word string, n long, edit string")


def near_pairs(words: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Each pair of near words once: a, n_a, b, n_b. `words` is a written table of different words and their n."""
    spark = words.sparkSession
    sizes = {r["size"]: r["n"] for r in words.groupBy(F.length("word").alias("size")).count().withColumnRenamed("count", "n").collect()}  # one row a length
    if not sizes:
        return spark.createDataFrame([], "a string, n_a long, b string, n_b long")
    letters = np.array(sorted(ord(r["c"]) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").distinct().collect()), np.uint8)  # 90 at most
    segments = {size: -(-n * BITS // SEGMENT_BITS) for size, n in sorted(sizes.items())}
    first, total = {}, 0
    for size, n in segments.items():
        first[size], total = total, total + n
    bitmaps = settled(_filters(words, segments, first), "filters")
    pairs = None
    for low in range(0, total, at_once):
        high = min(low + at_once, total)
        have = {r["number"]: bytes(r["bitmap"]) for r in bitmaps.where(F.col("number").between(low, high - 1)).collect()}
        filters = Filters(first, segments, low, [have.get(i, bytes(SEGMENT_BITS // 8)) for i in range(low, high)])
        there = [s for s in segments if first[s] < high and first[s] + segments[s] > low]
        able = words.where(F.length("word").isin(sorted({*there, *(s + 1 for s in there)})))
        maybe = _probed(_spread(spark, able), letters, filters).select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("edit").alias("b"))
        one = settled(maybe.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").select("a", "n_a", "b", "n_b"), "near")
        pairs = one if pairs is None else pairs.unionByName(one)
    return pairs


def _spread(spark: SparkSession, words: DataFrame) -> DataFrame:
    """Words dealt evenly: a small table makes much work, and its few files would be few tasks."""
    return words.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "word")


def variants(counts: DataFrame, shortest: int = 6, least: int = 5, ratio: int = 5, at_once: int = AT_ONCE) -> DataFrame:
    """One row per word of at least `shortest` letters and `least` occurrences: word, n, n_near, form, form_n, root.

    form is the near word of largest n, then first in code-point order, if its n is at least `ratio` (2 or more) times the word's; root follows forms
    to the last, and is the word itself without one. Each form is `ratio` times as frequent as the last, so their chains are short.
    """
    words = settled(counts.where((F.length("word") >= shortest) & (F.col("n") >= least)), "vocabulary")
    pairs = near_pairs(words, at_once)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    follows = -F.col("best.less") >= ratio * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n"))
    found = settled(found, "forms")
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that are followed
        nexts = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = settled(roots.join(nexts, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = new.select("word", "root")
        if new.where("moved").isEmpty():
            break
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

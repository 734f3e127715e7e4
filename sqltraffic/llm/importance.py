"""Resampling documents towards a target's distribution of hashed word runs.

Features of a text are its runs of 1 to `longest` consecutive words, each counted as often as it stands there, in buckets by
crc32. A bucket's gain is the logarithm of how much more often the target has it than the documents, in thousandths, cut
down. Every document is scored against the array of gains: its weight is the floored mean over its features. A
Gumbel number drawn from the seed and the id is added, so that the highest scores are a draw without replacement.

The draw is found by bisection of numbers: scores are written once, jobs count exactly how many rows lie on one side
of some thresholds (15 at once, four halvings), until the cutoff is known; ties at it are cut by doc_id in the same way, and rows that repeat with
one id and score by their place in the written table. Only the rows above the cutoff are dealt by ranges, and ranks are counted
range by range.

A null text has no words and weight 0. A null id is drawn with as the empty text, and comes last among ties. Documents below
`min_words` are never drawn. Empty tables give no rows; without any target word all gains follow from the documents alone. Of the
documents only the columns in `keep` are carried, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltraffic.operators.numbering import numbered

from .common import portions, settled, text_batches
from .words import pieces, raw

#: Counted at once: four halvings of what is left.
PROBES = 15
LAST = (1 << 63) - 1


def feature_hashes(text: bytes, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each piece of a text, how many words it has, and the crc32 of every run of words that ends in it."""
    before: list[bytes] = []
    for words in pieces(text):
        seen, ends = [*before, *words], []
        runs = list(map(crc32, seen))
        for length in range(1, longest + 1):
            if length > 1:  # the crc of a run, a space and the next word goes on from that of the run
                runs = list(map(crc32, seen[length - 1 :], map(crc32, repeat(b" "), runs)))
            ends.append(runs[max(0, len(before) - length + 1) :])
        yield len(words), np.fromiter(chain.from_iterable(ends), np.int64, sum(map(len, ends)))
        before = seen[max(0, len(seen) - longest + 1) :]


def bucket_counts(docs: DataFrame, buckets: int, longest: int, text: str = "text") -> list[int]:
    """How many features of all texts fall into each bucket. Tasks count in an array; the driver gets one number a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in portions(batches, lambda b: b.column(0)):
            for data in raw(batch.column(0)).to_pylist():
                for _, found in feature_hashes(data or b"", longest):
                    total += np.bincount(found % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    counted = text_batches(docs.select(F.col(text).alias("text"))).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = [0] * buckets
    for r in counted.collect():  # one row a bucket
        total[r["bucket"]] = r["n"]
    return total


def gains(docs: list[int], target: list[int]) -> np.ndarray:
    """Each bucket's gain in thousandths, floored."""
    n, s_all, t_all = len(docs), sum(docs), sum(target)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(docs, target, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int, text: str, keep: list[str]) -> DataFrame:
    """Columns `keep`, packed as `row`, with n_words, n_features and weight."""
    row = docs.select(*keep).schema
    schema = T.StructType([T.StructField("row", row), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, lambda b: b.column(1)):
            out = []
            for data in raw(batch.column(1)).to_pylist():
                n_words = n = total = 0
                for words, found in feature_hashes(data or b"", longest):
                    n_words, n, total = n_words + words, n + len(found), total + int(gain[found % len(gain)].sum())
                out.append((n_words, n, total // n if n else 0))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=schema.names)

    return text_batches(docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))).mapInArrow(weigh, schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel number in thousandths, floored, from 32 bits of the seed's and the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def least(rows: DataFrame, value: Column, wanted: int) -> int:
    """The least x with at least `wanted` rows (1 or more, and there are so many) of a value up to x, by bisection."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        probes = sorted({low + (high - low) * i // (PROBES + 1) for i in range(1, PROBES + 1)})
        counts = rows.agg(*[F.count_if(value <= p) for p in probes]).first()
        for p, n in zip(probes, counts, strict=True):
            if n >= wanted:
                high = p
                break
            low = p + 1
    return low


def cut(rows: DataFrame, keys: list[Column], wanted: int) -> Column:
    """Which rows are the first `wanted` in the order of numeric keys; the last key tells all rows apart."""
    if wanted <= 0:
        return F.lit(False)
    key = keys[0]
    x = least(rows, key, wanted)
    before, at = rows.agg(F.count_if(key < x), F.count_if(key == x)).first()
    if before + at == wanted or len(keys) == 1:
        return key <= x
    return (key < x) | (key == x) & cut(rows.where(key == x), keys[1:], wanted - before)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, buckets: int = 10_000, longest: int = 2, min_words: int = 20,
             doc_id: str = "doc_id", text: str = "text", target_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every document's columns `keep` (all, if None), packed as `row`, with n_words, n_features, weight, score, and its rank from 1 if it is drawn.

    Drawn are floor(percent * N / 100) of the N documents with at least `min_words` words. `doc_id` is an integer column among `keep`.
    """
    gain = gains(bucket_counts(docs, buckets, longest, text), bucket_counts(target, buckets, longest, target_text))
    rows = weighed(docs, gain, longest, text, keep or docs.columns)
    rows = rows.withColumns({"score": F.col("weight") + gumbel(F.col("row")[doc_id], seed), "at": F.monotonically_increasing_id()})
    rows = settled(rows, "scores")
    able = rows.where(F.col("n_words") >= min_words)
    order = [-F.col("score"), F.coalesce(F.col("row")[doc_id].cast("long"), F.lit(LAST)), F.col("at")]
    first = (F.col("n_words") >= min_words) & cut(able, order, percent * able.count() // 100)
    ranked = numbered(rows.where(first), order, "place").withColumn("rank", F.col("place") + 1).drop("place", "at")
    return ranked.unionByName(rows.where(~first).drop("at").withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **options: object) -> DataFrame:
    """The documents drawn, with their own columns."""
    return resample(docs, target, **options).where("rank is not null").select("row.*")

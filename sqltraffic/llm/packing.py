"""Best-fit packing whose bins are certified by lower bounds.

Documents are tokenized once; only (row, piece, length) is packed, never the ids. Pieces that
fill a sequence stand alone. The others are dealt to partitions of bounded size by their order, so that documents that come close to
each other (as a mix has put them) meet in one, and
each is packed best-fit decreasing. Dual feasible functions give a lower bound of the bins that
a partition's pieces need. A partition that meets its bound is certified and done; those with
a gap put the pieces of their unfilled bins together, deal them anew by hash and pack them again, as
long as that saves bins. A sequence is numbered by the place of its first document in the order, so their numbers follow it. Pieces of equal length are
packed in that order.

A null text counts as empty and makes one piece, its end id. Rows that repeat, also with the
same or a null doc_id, are packed each on their own. A document longer than a sequence is cut so
that its first piece takes the remainder. An empty table gives no rows. Other columns are left
out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltraffic.operators.numbering import numbered_ranges

from .common import portions, settled, text_batches
from .token_ids import encoder

#: Pieces in one partition, on average; rounds of exchange at most.
PER_PARTITION, ROUNDS = 20_000, 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids in pieces of at most `capacity`: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = struct.pack("<I", end_id)
        for batch in portions(batches, lambda b: b.column("text")):
            ids, at = encoder(tokenizer).encode(batch.column("text"))
            raw, names = ids.tobytes(), batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for i, name in enumerate(names):
                own = raw[4 * at[i] : 4 * at[i + 1]] + end
                n = len(own) // 4
                start = 0
                for k, stop in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                    out.append((name, k, start, stop - start, zlib.crc32(own[4 * start : 4 * stop])))
                    start = stop
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound that two families of dual feasible functions give."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # Sizes above capacity - e count as full, those below e as nothing.
    number, total = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * size))
    e = np.arange(1, capacity // 2 + 1)
    full = number[-1] - number[capacity - e + 1]
    middle = total[capacity - e + 1] - total[e]
    best = max(best, int((-(-(full * capacity + middle) // capacity)).max(initial=0)))
    # Rounding to multiples of capacity / k, times k to stay whole.
    for k in range(1, 60):
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For lengths in descending order: each one's bin and its place there."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    free, made = 0, 0  # free: bit f is set if a bin has f left
    for i, n in enumerate(lengths.tolist()):
        if fits := free >> n:
            left = n + (fits & -fits).bit_length() - 1
            at = open_bins[left].pop()
            if not open_bins[left]:
                free ^= 1 << left
        else:
            left, at, made = capacity, made, made + 1
        bins[i], offsets[i] = at, capacity - left
        if left > n:
            open_bins[left - n].append(at)
            free |= 1 << (left - n)
    return bins, offsets


PLACED = "uid long, length long, part long, bin long, offset long, settled boolean, gap long"


def _pack_round(items: DataFrame, capacity: int, salt: int) -> DataFrame:
    """One round over uid, length and place: the first deals by place, the others by hash."""
    n = items.count()
    parts = max(1, -(-n // PER_PARTITION))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        made = int(bins.max()) + 1
        gap = made - lower_bound(lengths, capacity)
        filled = np.bincount(bins, lengths) == capacity
        return group.assign(bin=bins, offset=offsets, settled=filled[bins] | (gap == 0), gap=gap)[["uid", "length", "part", "bin", "offset", "settled", "gap"]]

    part = F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(parts)) if salt else F.floor(F.col("place") * parts / n)
    dealt = items.select("uid", "length", part.cast("long").alias("part"))
    return settled(dealt.groupBy("part").applyInPandas(pack, PLACED), "packed")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    all_pieces = settled(pieces(docs, tokenizer, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = all_pieces.where(F.col("length") == capacity)
    left = settled(all_pieces.where(F.col("length") < capacity).select("uid", "length", F.monotonically_increasing_id().alias("at")), "left")
    left = numbered_ranges(left, [], "place")

    done: list[DataFrame] = []
    for turn in range(ROUNDS):
        placed = _pack_round(left, capacity, turn).withColumn("turn", F.lit(turn))
        unsettled = placed.where("not settled")
        stat = placed.agg(F.countDistinct("part").alias("parts"), F.countDistinct(F.when(~F.col("settled"), F.struct("part", "bin"))).alias("bins"), F.sum(F.when(~F.col("settled"), F.col("length"))).alias("load"), F.countDistinct(F.when(~F.col("settled"), F.col("part"))).alias("open")).first()
        # Nothing to gain: all certified, or the unfilled bins hold what they must, or one partition is all there is.
        if not stat["bins"] or stat["bins"] == -(-stat["load"] // capacity) or stat["open"] < 2 or turn == ROUNDS - 1:
            done.append(placed)
            break
        done.append(placed.where("settled"))
        left = unsettled.select("uid", "length", F.lit(None).cast("long").alias("place"))
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    # A sequence has the number of its first piece, full ones too; bins are told apart by round and partition.
    own = ["turn", "part", "bin"]
    firsts = bins.groupBy(*own).agg(F.min("uid").alias("sequence_id"))
    placed = bins.join(firsts, own).select("uid", "sequence_id", "offset")
    alone = whole.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return all_pieces.where(F.col("length") < capacity).join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").unionByName(alone)

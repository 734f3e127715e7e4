"""Exact Jaccard self-join of word-shingle sets with signature trees.

1. Documents with equal sets are one class, known by a 128-bit fingerprint of the set and named by the
   number of one of its rows; from here on only classes are joined. A Bloom filter (bloom.py) tells which rows
   may have an equal; the others do not move.
2. Shingles have one global order, rarest first: by a table of CELLS counters over the whole corpus,
   then by hash. Two sets of similarity s share a shingle among the first n - ceil(s n) + 1 of
   each, so classes meet in runs, one for each shingle that two or more have among those. Passages
   that very many documents share come last in the order and make no runs.
3. HUB_ROUNDS times, each class is compared with the class that comes first most often among those of about its
   size in its runs and is not of its component yet: one pair for a class, whatever the size of a group of near
   copies. In the first round that is the class with the fewest rarer shingles, so copies meet the text that they
   are made from; later rounds draw it, and bound sizes elsewhere. Pairs whose signatures allow it are verified on whole sets, and links make components.
4. What is left are pairs of different components in a run. A tree over the run's classes has at
   its nodes the OR of their token bitmaps and their range of sizes; two nodes are gone through
   together only if a pair below them may overlap enough, and if they are not of one component. A pair is let through in
   its first common run, as far as the classes' runs before tell. Those let through are verified exactly, on whole sets.

Runs that stay large are dealt out as pairs of blocks. No link between different components is
lost, so components are exact. A document without words (or with a null text) has an empty
set and links with nothing. Rows that repeat fall into one class, also with different ids; a null
doc_id is the smallest of none. An empty table gives no rows. Other columns, whatever their names, are left out
(jaccard_components) or carried along (near_dedup). A text is in memory with the portion that it is read in.

The counters (CELLS) and the filter of wanted sets (FILTER_BITS) have fixed sizes. In a corpus that
fills them, the order tells less about rareness and more sets than needed are read; results are the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import may_repeat
from .common import forget, passing_tables, portions, settled, text_batches, width, with_groups
from .components import components
from .shingles import fingerprints, shingle_sets

#: Similarity as a fraction: NEED / OF.
NEED, OF = 4, 5
#: Counters for the order of shingles, and in how many parts they are summed.
CELLS, SLICES = 1 << 21, 64
#: 64-bit words of a signature in a tree; classes in a leaf; children of a node; rows of a run in one block.
SIGNATURE, LEAF, FAN, BLOCK = 16, 32, 8, 8192
#: Bits of the filter that tells which classes' sets are needed.
FILTER_BITS = 1 << 25
#: Rounds in which each class is compared with one other.
HUB_ROUNDS = 2
#: Pairs of small runs that are tested at once.
AT_ONCE = 1 << 18


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How often shingles of each cell occur, over all documents; a fixed CELLS numbers.

    A task's own count of a cell stops at 65,535: beyond, a shingle is as common as can be.
    """
    part = CELLS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        cells = np.zeros(CELLS, np.int32)
        for batch in portions(batches, lambda b: b.column(0)):
            sets = shingle_sets(batch.column(0))
            np.add.at(cells, (np.concatenate(sets) & np.uint64(CELLS - 1)).view(np.int64), 1)
        packed = [zlib.compress(c.tobytes(), 1) for c in np.minimum(cells, 65535).astype("<u2").reshape(SLICES, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES)), pa.array(packed, pa.binary())], names=["slice", "counts"])

    def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(part, np.int64)
        for table in tables:
            for x in table.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_py()), "<u2")
        packed = zlib.compress(np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([packed], pa.binary())], names=["slice", "counts"])

    sums = text_batches(docs.select("text")).mapInArrow(count, "slice long, counts binary").groupBy("slice").applyInArrow(add, "slice long, counts binary")
    out = np.zeros((SLICES, part), np.uint32)
    for row in sums.collect():  # CELLS numbers, whatever the corpus
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), "<u4")
    return out.ravel()


def shingled(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """A row for each document: uid, doc_id, n, name (of its set), prefix (its first shingles in the global order), signature, bitmap."""
    order = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in portions(batches, lambda b: b.column("text")):
            prefixes, marks, maps = [], [], []
            sets = shingle_sets(batch.column("text"))
            for s in sets:
                size = len(s) - -(-NEED * len(s) // OF) + 1 if len(s) else 0
                by = np.argsort(order.value[s & np.uint64(CELLS - 1)], kind="stable")  # a set is in order of hash
                prefixes.append(s[by[:size]])
                bits = bitmap(s)
                maps.append(bits.tobytes() if len(bits) > SIGNATURE else None)
                marks.append(folded(bits, SIGNATURE).tobytes())
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate([*prefixes, np.empty(0, np.uint64)])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fingerprints(sets), pa.binary()), lists, pa.array(marks, pa.binary()), pa.array(maps, pa.binary())], names=["doc_id", "n", "name", "prefix", "signature", "bitmap"])

    rows = text_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n long, name binary, prefix array<long>, signature binary, bitmap binary")
    return settled(rows.withColumn("uid", F.monotonically_increasing_id()), "shingled")


def classes(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What class each document is of (uid, doc_id, n, class), and the classes: class, n, name, prefix, signature, bitmap."""
    marked = may_repeat(known.where("name is not null"), F.xxhash64("name"))
    rows = marked.select("maybe", "row.*")
    alone = rows.where("not maybe").select(F.col("uid").alias("class"), "n", "name", "prefix", "signature", "bitmap")
    first = rows.where("maybe").groupBy("name").agg(F.min(F.struct("uid", "n", "prefix", "signature", "bitmap")).alias("first"), F.count("*").alias("copies"))
    first = settled(first, "copies")
    reps = alone.unionByName(first.select(F.col("first.uid").alias("class"), "first.n", "name", "first.prefix", "first.signature", "first.bitmap"))
    again = with_groups(rows.where("maybe").select("uid", "doc_id", "n", "name"), first.select("name", F.col("first.uid").alias("class"), "copies"), "name", "copies")
    keys = ["doc_id", "n", "class"]
    of = rows.where("not maybe").select("doc_id", "n", F.col("uid").alias("class")).unionByName(again.select(*keys))
    return settled(of.unionByName(known.where("name is null").select("doc_id", "n", F.lit(None).cast("long").alias("class"))), "class-of"), settled(reps, "classes")


def _size_step(n: np.ndarray, turn: int) -> np.ndarray:
    """Sizes that differ by less than a quarter are of one step or of two that follow each other; each turn's steps begin in the middle of the last one's."""
    return np.floor(np.log(n) / np.log(OF / NEED) + turn / 2).astype(np.int64)


def _with_hubs(rows: DataFrame, turn: int) -> DataFrame:
    """Rows of runs of two or more with `hub`: the first class of the run and size, if that is of another component.

    `rows`: h, n, class, pos and, after the first turn, component. In the first turn that class is first which has the fewest shingles
    rarer than the run's: of a group of near copies the one that most of the others are made from, which links with more of them than any other.
    Later it is one drawn by a hash, which changes with the turn.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_hub, held_of, held_has = None, 0, 0, False  # the last row so far: whether its run goes on shows in the next

        def out(cols: list[np.ndarray], hub: np.ndarray, none: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in cols[:4]), pa.array(hub[keep], mask=none[keep])], names=["h", "n", "class", "pos", "hub"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.append(x, c) for x, c in zip(held, cols, strict=True)]
            h, step = cols[0], _size_step(cols[1], turn)
            same = np.append(False, h[1:] == h[:-1])
            opens = ~same | np.append(True, step[1:] != step[:-1])
            at = np.maximum.accumulate(np.where(opens, np.arange(len(h)), 0))
            hub, of = cols[2][at], cols[4][at]
            if held is not None:  # the first group goes on
                hub[at == 0], of[at == 0] = held_hub, held_of
            none = of == cols[4]
            has = same | np.append(same[1:], False)
            has[0] |= held_has
            yield out([c[:-1] for c in cols], hub[:-1], none[:-1], has[:-1])
            held, held_hub, held_of, held_has = [c[-1:] for c in cols], hub[-1], of[-1], bool(has[-1])
        if held is not None and held_has:
            yield out(held, np.array([held_hub]), np.array([held_of]) == held[4], np.array([True]))

    step = F.floor(F.log("n") / float(np.log(OF / NEED)) + turn / 2)
    of = F.col("component") if "component" in rows.columns else F.col("class").alias("component")
    ordered = rows.repartition(width(rows.sparkSession), "h").sortWithinPartitions("h", step, *([] if turn else ["pos"]), F.xxhash64("class", F.lit(turn)))
    return ordered.select("h", "n", "class", "pos", of).mapInArrow(find, "h long, n int, class long, pos int, hub long")


def hub_pairs(rows: DataFrame) -> DataFrame:
    """Each class with the hub of most of its runs: pairs (a, b), a < b."""
    one = rows.where("hub is not null").groupBy("class").agg(F.mode("hub", True).alias("hub"))
    return one.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()


def class_sets(docs: DataFrame, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(class, shingles) of the classes in the pairs, shingles as bytes in order of hash."""
    needed = settled(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(reps.select("class", "name"), "class"), "wanted")
    bit = F.pmod(F.conv(F.hex(F.substring("name", 1, 4)), 16, 10).cast("long"), F.lit(FILTER_BITS))
    bitmaps = needed.select(bit.alias("bit")).groupBy((F.col("bit") / 32768).cast("int").alias("at")).agg(F.expr("bitmap_construct_agg(cast(bit % 32768 as int))").alias("bits"))
    wanted = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for row in bitmaps.collect():  # FILTER_BITS bits at most
        wanted[row["at"]] = np.frombuffer(row["bits"], np.uint8)
    wanted = docs.sparkSession.sparkContext.broadcast(wanted.ravel())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, lambda b: b.column(0)):
            names, sets = [], []
            own = shingle_sets(batch.column(0))
            for s, name in zip(own, fingerprints(own), strict=True):
                if name:
                    at = int.from_bytes(name[:4], "big") % FILTER_BITS
                    if wanted.value[at >> 3] >> (at & 7) & 1:
                        names.append(name)
                        sets.append(s.tobytes())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], names=["name", "shingles"])

    found = text_batches(docs.select("text")).mapInArrow(read, "name binary, shingles binary").groupBy("name").agg(F.first("shingles").alias("shingles"))
    return found.join(needed, "name").select("class", "shingles")


def possible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and bitmaps let them be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                ok = OF * min(n, m) >= NEED * max(n, m)
                if ok:
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    x, y = folded(x, len(y)), folded(y, len(x))
                    more = min(n - int(np.bitwise_count(x).sum()), m - int(np.bitwise_count(y).sum()))
                    ok = (NEED + OF) * (int(np.bitwise_count(x & y).sum()) + more) >= NEED * (n + m)
                keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = marks.select(F.col("class").alias("a"), "n", F.col("bitmap").alias("x"))
    right = marks.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("bitmap").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle; SIGNATURE words at least, and for large sets as many as keep half of the bits free."""
    words = SIGNATURE
    while 32 * words < len(shingles):
        words *= 2
    bits = np.zeros(64 * words, np.uint8)
    bits[(shingles >> np.uint64(20)) & np.uint64(64 * words - 1)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap as it is with so many words, if it has more."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0) if len(bits) > words else bits


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(OF * both >= NEED * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = class_sets(docs, pairs, reps).repartition(width(docs.sparkSession), "class")  # dealt once for both sides
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    return settled(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


class _Tree:
    """A node's OR bitmap, sizes, excess of tokens over bits, and components, for each level of a run."""

    def __init__(self, n: np.ndarray, excess: np.ndarray, comp: np.ndarray, bits: np.ndarray) -> None:
        self.levels = []
        step = LEAF
        low, high, more, first, last, union = n, n, excess, comp, comp, bits
        while True:
            at = np.arange(0, len(low), step)
            low, high, more = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)
            first, last, union = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at), np.bitwise_or.reduceat(union, at, axis=0)
            self.levels.append((low, high, more, first, last, union))
            step = FAN
            if len(low) == 1:
                break

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high, more, first, last, union = self.levels[level]
        overlap = np.bitwise_count(union[a] & union[b]).sum(1, dtype=np.int64) + np.minimum(more[a], more[b])
        return (
            (OF * np.minimum(high[a], high[b]) >= NEED * np.maximum(low[a], low[b]))
            & ((first[a] != last[a]) | (first[b] != last[b]) | (first[a] != first[b]))
            & ((NEED + OF) * overlap >= NEED * (low[a] + low[b]))
        )

    def leaf_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ok = self.may_link(level, a, b)
            a, b = a[ok], b[ok]
            if level:
                size = len(self.levels[level - 1][0])
                grid = np.arange(FAN)
                x = np.repeat(a * FAN, FAN * FAN) + np.tile(np.repeat(grid, FAN), len(a))
                y = np.repeat(b * FAN, FAN * FAN) + np.tile(np.tile(grid, FAN), len(b))
                ok = (x < size) & (y < size) & (x <= y)
                a, b = x[ok], y[ok]
        return a, b


def _may_link(i: np.ndarray, j: np.ndarray, c: dict[str, np.ndarray]) -> np.ndarray:
    """Which of the pairs of rows of one run have to be verified, and are met here first."""
    n, pos, bits = c["n"], c["pos"], c["bits"]
    low, both = np.minimum(n[i], n[j]), n[i] + n[j]
    ok = (c["component"][i] != c["component"][j]) & (c["before"][i] != c["before"][j]) & (OF * low >= NEED * (both - low))
    ok &= (c["i"][i] == c["j"][i]) | (c["own"][i] != c["own"][j])  # pairs inside a block are met where the block stands alone
    rest = 1 + np.minimum(n[i] - 1 - pos[i], n[j] - 1 - pos[j])  # holds where this is their first common shingle
    ok &= (NEED + OF) * rest >= NEED * both
    at = np.flatnonzero(ok)
    i, j = i[at], j[at]
    overlap = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64) + np.minimum(c["excess"][i], c["excess"][j])
    ok[at] = (NEED + OF) * overlap >= NEED * both[at]
    return ok


def run_pairs(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows in one run that may be linked, by its tree."""
    order = np.lexsort((c["class"], c["component"], c["n"]))
    own = {k: v[order] for k, v in c.items()}
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for x, y in zip(*_Tree(own["n"], own["excess"], own["component"], own["bits"]).leaf_pairs(), strict=True):
        i, j = np.arange(x * LEAF, min(len(order), (x + 1) * LEAF)), np.arange(y * LEAF, min(len(order), (y + 1) * LEAF))
        i, j = np.repeat(i, len(j)), np.tile(j, len(i))
        i, j = i[i < j], j[i < j]
        ok = _may_link(i, j, own)
        left.append(order[i[ok]])
        right.append(order[j[ok]])
    return np.concatenate(left), np.concatenate(right)


@lru_cache(maxsize=LEAF + 1)
def _all_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _pairs_of_runs(c: dict[str, np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes from whole runs, which begin at `bounds`; a run of LEAF rows at most is a tree of one leaf."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    i, j, held = [], [], 0

    def flush() -> None:
        nonlocal i, j, held
        if i:
            x, y = np.concatenate(i), np.concatenate(j)
            ok = _may_link(x, y, c)
            a.append(c["class"][x[ok]])
            b.append(c["class"][y[ok]])
        i, j, held = [], [], 0

    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if high - low > LEAF:
            x, y = run_pairs({k: v[low:high] for k, v in c.items()})
            a.append(c["class"][low + x])
            b.append(c["class"][low + y])
        elif high - low > 1:
            x, y = _all_pairs(high - low)
            i.append(x + low)
            j.append(y + low)
            held += len(x)
            if held > AT_ONCE:
                flush()
    flush()
    a, b = np.concatenate(a), np.concatenate(b)
    both = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def tree_pairs(shared: DataFrame, marks: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that the trees of all runs let through.

    `before` is the class's run before in the global order. Two classes that have the same one meet there
    already, so they are left to it; in their first common run it differs.
    """
    before = F.coalesce(F.lag("h").over(Window.partitionBy("class").orderBy("pos")), F.col("class"))
    rows = shared.select("h", "n", "class", "pos").join(of, "class", "left").select("h", "n", "class", "pos", F.coalesce("component", "class").alias("component"), before.alias("before"))
    rows = settled(rows, "run-rows")
    mixed_runs = rows.groupBy("h").agg(F.count("*").alias("rows"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    mixed_runs = mixed_runs.select("h", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(mixed_runs, "h")
    # A run of more than BLOCK rows is dealt as pairs of blocks; each row stands in as many as there are blocks.
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = rows.join(marks.select("class", "signature"), "class")
    numbers = ["i", "j", "own", "n", "pos", "class", "component", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # a run goes on; none has more rows than two blocks
        for batch in batches:
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            key = [table.column(c).to_numpy() for c in ("h", "i", "j")]
            starts = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in key]))) if len(table) else np.zeros(1, np.int64)
            held = table.slice(starts[-1]).to_batches()
            if starts[-1]:
                yield found(table.slice(0, starts[-1]), starts)
        if held:
            table = pa.Table.from_batches(held)
            yield found(table, np.array([0, len(table)]))

    def found(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        c = {k: table.column(k).to_numpy().astype(np.int64) for k in numbers}
        c["bits"] = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint64).reshape(len(table), SIGNATURE)
        c["excess"] = c["n"] - np.bitwise_count(c["bits"]).sum(1, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs_of_runs(c, bounds)], names=["a", "b"])

    dealt = rows.select("h", *numbers, "signature").repartition(width(shared.sparkSession), "h", "i", "j").sortWithinPartitions("h", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, n and component of each document with words; doc_id and n of the others."""
    class_of, reps = classes(shingled(docs, shingle_counts(docs)))
    marks = reps.select("class", "n", "signature", F.coalesce("bitmap", "signature").alias("bitmap"))
    prefixes = reps.select("class", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "h"))
    shared = rows = settled(_with_hubs(prefixes, 0), "runs")
    edges, tried, of = None, None, None
    for turn in range(HUB_ROUNDS):
        if turn:
            named = shared.drop("hub").join(of, "class", "left").withColumn("component", F.coalesce("component", "class"))
            rows = _with_hubs(named, turn)
        pairs = hub_pairs(rows)
        pairs = settled(possible(pairs.join(tried, ["a", "b"], "left_anti") if turn else pairs, marks), "pairs")
        if turn and pairs.isEmpty():
            break
        links = verified(pairs, docs, reps)
        edges, tried = (edges.unionByName(links), tried.unionByName(pairs)) if turn else (links, pairs)
        of = components(edges).withColumnRenamed("node", "class")
    more = settled(tree_pairs(shared, marks, of).distinct().join(tried, ["a", "b"], "left_anti"), "tree-pairs")
    more = settled(possible(more, marks), "pairs")
    if not more.isEmpty():
        of = components(edges.unionByName(verified(more, docs, reps))).withColumnRenamed("node", "class")
    linked = class_of.where("class is not null").join(of, "class", "left").select("doc_id", "n", F.coalesce("component", "class").alias("component"))
    return settled(linked, "rows", stays=True), settled(class_of.where("class is null").select("doc_id", "n"), "wordless", stays=True)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    with passing_tables(docs.sparkSession):
        linked, wordless = _linked(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    first = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("documents"))
    named = with_groups(linked, settled(first, "components"), "component", "documents").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return named.unionByName(wordless.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all columns: of each component the one of the smallest doc_id.

    Rows that share an id are judged together; rows with a null id stay.
    """
    dropped = jaccard_components(docs, doc_id, text).where("doc_id != component_id").select("doc_id").distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"))
    return packed.join(dropped, "doc_id", "left_anti").select("row.*")

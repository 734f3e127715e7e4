"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one class. A first neighbour graph comes from ORDERS sorted orders by
random-hyperplane signatures: vectors that are close tend to stand side by side. Then it is
refined: around each vector, its neighbours and those that have it as theirs are compared with
each other, and pairs better than the worst in either list are put in; rounds go on until few lists change. What the
pairs of cosine THRESHOLD or more that were met on the way join stays joined, also by those that no list has room for: it makes components.

Links are counted in the whole component: its members are compared in pairs of blocks. An audit compares some
vectors of each label (every AUDIT_STEP-th, or AUDIT_LEAST at the least) with all of it, in blocks. Labels of whose links less than RECALL were found are
refined again: lists that are full of links are saturated, and get twice the room; other orders are drawn. Labels that are still short after
TRIES are compared in full, in pairs of blocks.

Vectors that are null, of length zero or with null or non-finite components, and those without a label or an id,
have no links and are their own component. Rows that repeat count as vectors of their own. Neighbours of equal cosine are told apart by their
ids. Labels may be of any type that can be compared; vectors are arrays of floats or doubles. An
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled, width, with_groups
from .components import components

THRESHOLD = 0.93
#: Length of lists, sorted orders, neighbours taken from each, bits of a signature.
LIST, ORDERS, REACH, BITS = 8, 6, 3, 24
ROUNDS, FEW, TRIES = 3, 0.02, 3
#: Vectors that are compared with each other in one task: around a vector, and of a component.
AROUND, BLOCK = 256, 1024
#: One class in so many is audited, but so many of a label at the least.
AUDIT_STEP, AUDIT_LEAST = 50, 32
RECALL, QUERIES = 0.97, 256
EDGES = "a long, b long, sim double"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of length one, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _named() -> Column:
    """A class by 128 bits of its label and vector."""
    halves = [F.hex(F.xxhash64(F.lit(turn), "label", "vector")) for turn in (1, 2)]
    return F.when(F.col("vector").isNotNull(), F.concat_ws("-", *halves))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with the name of their class, and a row (class, label, vector, copies, name) for each class."""
    fine = F.size("embedding") > 0
    fine &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine, F.col("embedding")).alias("vector"))
    groups = rows.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").cast("long").alias("class"), F.count("*").alias("copies"))
    groups = settled(groups.withColumn("name", _named()), "vectors")
    return rows.select("vec_id", _named().alias("name")), groups


def first_graph(groups: DataFrame, reach: int = REACH, seed: int = 3) -> DataFrame:
    """Edges between vectors that stand close in one of the sorted orders. All orders are one table, so they are dealt and sorted at once."""
    rows = groups.select("class", "label", "vector")
    order = ["turn", "label", "size", "key"]
    signs = T.StructType([*rows.schema, *[T.StructField(c, T.LongType()) for c in ("turn", "size", "key")]])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("vector")], np.int64)
            for turn in range(ORDERS):
                keys = np.zeros(batch.num_rows, np.int64)
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    planes = np.random.default_rng((seed, turn, int(size))).normal(size=(int(size), BITS))
                    keys[at] = ((_matrix(batch.column("vector").take(pa.array(at))) @ planes) > 0) @ (1 << np.arange(BITS))
                more = [np.full(batch.num_rows, turn, np.int64), sizes, keys]
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], names=signs.names)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([*([held] if held else []), batch]).combine_chunks()
            same = [table.column(c).to_numpy() for c in ("turn", "label", "size")]
            size, name = same[-1], table.column("class").to_numpy()
            pairs = [(at, at + step) for step in range(1, reach + 1) for at in [np.flatnonzero(np.logical_and.reduce([c[:-step] == c[step:] for c in same]))]]
            a, b = (np.concatenate(side) for side in zip(*pairs, strict=True))
            sims = np.empty(len(a))
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                place = np.zeros(len(size), np.int64)
                place[own] = np.arange(len(own))
                x, at = _matrix(table.column("vector").take(pa.array(own))), size[a] == n
                sims[at] = np.einsum("ij,ij->i", x[place[a[at]]], x[place[b[at]]])
            yield pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b]), pa.array(sims)], names=["a", "b", "sim"])
            held = table.slice(max(0, len(table) - reach)).to_batches()[0] if len(table) else None

    dealt = rows.mapInArrow(sign, signs).repartitionByRange(width(groups.sparkSession), *order)
    return dealt.sortWithinPartitions(*order, "class").mapInArrow(link, EDGES)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def best_lists(edges: DataFrame, rooms: DataFrame) -> DataFrame:
    """(a, room, near, worst): each vector's best neighbours, as (sim, b), as many as it has room for, and the last one's cosine."""
    found = _both_ways(edges).groupBy("a", "b").agg(F.max("sim").alias("sim")).join(rooms, "a")
    ranked = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    kept = found.withColumn("rank", ranked).where(F.col("rank") <= F.col("room"))
    full = F.when(F.count("*") == F.col("room"), F.min("sim")).otherwise(F.lit(-2.0))
    return kept.groupBy("a", "room").agg(F.collect_list(F.struct("sim", "b")).alias("near"), full.alias("worst"))


def _stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member of a block that is not the first of its component there: the first one, and itself."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        front = np.array([i] if root[i] < 0 else [], np.int64)
        while len(front):
            root[front] = i
            front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
    at = np.flatnonzero(root != np.arange(len(root)))
    return root[at], at


def refine(groups: DataFrame, lists: DataFrame) -> DataFrame:
    """New edges (a, b, sim) among the neighbours of each vector that improve one of their lists. Links that do not are as many as join what
    they join: one for each vector but the first of a block's component. Those have no cosine of their own, which keeps them out of the lists."""
    edges = lists.select("a", F.explode("near").alias("x")).select("a", F.col("x.b").alias("b"))
    around = edges.select(F.col("a").alias("center"), F.col("b").alias("member")).union(edges.select("b", "a")).union(lists.select("a", F.col("a"))).distinct()
    sizes = around.groupBy("center").agg(F.ceil(F.count("*") / AROUND).cast("int").alias("parts"))
    dealt = around.join(sizes, "center").withColumn("part", F.pmod(F.xxhash64("center", "member"), F.col("parts")))
    dealt = dealt.join(lists.select(F.col("a").alias("member"), "worst"), "member").join(groups.select(F.col("class").alias("member"), "vector"), "member")

    def compare(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(tables))
        name, worst, x = table.column("member").to_numpy(), table.column("worst").to_numpy(), _matrix(table.column("vector"))
        sims = x @ x.T
        i, j = np.nonzero(np.triu((sims > worst[:, None]) | (sims > worst[None]), 1))
        yield pa.RecordBatch.from_arrays([pa.array(name[i]), pa.array(name[j]), pa.array(sims[i, j])], names=["a", "b", "sim"])
        i, j = _stars(sims >= THRESHOLD)
        yield pa.RecordBatch.from_arrays([pa.array(name[i]), pa.array(name[j]), pa.nulls(len(i), pa.float64())], names=["a", "b", "sim"])

    return dealt.select("center", "part", "member", "worst", "vector").groupBy("center", "part").applyInArrow(compare, EDGES)


def descend(groups: DataFrame, rooms: DataFrame, turn: int = 0) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) among the pairs that the graph and its rounds have compared, and the lists of the last round."""
    n = groups.count()
    found = settled(first_graph(groups, REACH << turn, seed=3 + turn), "first-edges")
    lists = settled(best_lists(found, rooms), "lists")
    for _ in range(ROUNDS):
        old = lists.select("a", F.explode("near").alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.sim").alias("sim"))
        new = settled(refine(groups, lists), "new-edges")
        found = found.unionByName(new)
        better = settled(best_lists(old.unionByName(new.where("sim is not null")), rooms), "lists")
        changed = better.select("a", "worst").join(lists.select("a", F.col("worst").alias("before")), "a").where("worst > before + 1e-12").count()
        lists = better
        if changed < FEW * n:
            break
    # Lists get better round by round, and many pairs are met again and again.
    return settled(found.where(F.coalesce(F.col("sim") >= THRESHOLD, F.lit(True))).select("a", "b").distinct(), "links-met"), lists


def enlarged(rooms: DataFrame, lists: DataFrame) -> DataFrame:
    """Twice the room for vectors whose lists are full of links."""
    saturated = lists.where(F.col("worst") >= THRESHOLD).select("a", F.lit(2).alias("times"))
    return rooms.join(saturated, "a", "left").select("a", (F.col("room") * F.coalesce("times", F.lit(1))).alias("room"))


def label_edges(groups: DataFrame) -> DataFrame:
    """Edges (a, b) that join what links join, from all pairs of each label, in blocks: a star for each component of a pair of blocks."""
    sized = groups.select("class", "label", "vector", F.size("vector").alias("size"))
    blocks = sized.groupBy("label", "size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = sized.join(blocks, ["label", "size"]).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(tables))
        name, x = table.column("class").to_numpy(), _matrix(table.column("vector"))
        i, j = _stars(x @ x.T >= THRESHOLD)
        yield pa.RecordBatch.from_arrays([pa.array(name[i]), pa.array(name[j])], names=["a", "b"])

    return dealt.select("label", "size", "i", "j", "class", "vector").groupBy("label", "size", "i", "j").applyInArrow(compare, "a long, b long")


def component_links(groups: DataFrame, of: DataFrame) -> DataFrame:
    """(class, links): vectors that each class is linked with, from all pairs of its component, in blocks."""
    members = of.withColumnRenamed("node", "class").join(groups.select("class", "copies", "vector"), "class")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(tables))
        name, copies, own, x = table.column("class").to_numpy(), table.column("copies").to_numpy(), table.column("own").to_numpy(), _matrix(table.column("vector"))
        i, j = key[1].as_py(), key[2].as_py()
        linked = x @ x.T >= THRESHOLD
        np.fill_diagonal(linked, False)
        if i != j:  # pairs inside a block are compared where the block stands alone
            linked &= own[:, None] != own[None]
        yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(linked @ copies)], names=["class", "links"])

    each = dealt.select("component", "i", "j", "class", "copies", "own", "vector").groupBy("component", "i", "j").applyInArrow(compare, "class long, links long")
    return each.groupBy("class").agg(F.sum("links").alias("links"))


def audit(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Labels of which `found` counts less than RECALL of the links of the audited classes (with all of their label)."""
    steps = groups.groupBy("label").agg(F.greatest(F.lit(1), F.least(F.lit(AUDIT_STEP), F.floor(F.count("*") / AUDIT_LEAST))).alias("step"))
    asked = groups.join(steps, "label").where(F.pmod(F.xxhash64("class"), F.col("step")) == 0).drop("step")
    blocks = asked.groupBy("label").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    slices = groups.groupBy("label").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("slices"))
    both = blocks.join(slices, "label")
    each = ["label", "block", "slice", "class", "copies", "vector"]
    hashed, every = F.xxhash64("class"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = asked.join(both, "label").withColumn("block", F.pmod(hashed, F.col("blocks")).cast("int")).withColumn("slice", every("slices"))
    rows = groups.join(both, "label").withColumn("slice", F.pmod(hashed, F.col("slices")).cast("int")).withColumn("block", every("blocks"))
    queries, rows = queries.select(*each, F.lit(True).alias("query")), rows.select(*each, F.lit(False).alias("query"))

    def compare(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(tables))
        query = table.column("query").to_numpy()
        name, copies, x = table.column("class").to_numpy(), table.column("copies").to_numpy(), _matrix(table.column("vector"))
        linked = (x[query] @ x[~query].T >= THRESHOLD) & (name[query][:, None] != name[~query][None])
        yield pa.RecordBatch.from_arrays([pa.array(name[query]), pa.array(linked @ copies[~query])], names=["class", "truth"])

    truth = queries.unionByName(rows).groupBy("label", "block", "slice").applyInArrow(compare, "class long, truth long").groupBy("class").agg(F.sum("truth").alias("truth"))
    by_label = truth.join(found, "class", "left").join(groups.select("class", "label"), "class").groupBy("label")
    counted = by_label.agg(F.sum("truth").alias("truth"), F.sum(F.least("truth", F.coalesce("links", F.lit(0)))).alias("found"))
    return counted.where(F.col("found") < RECALL * F.col("truth")).select("label")


def _joined(groups: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components that edges make, and their classes' links."""
    of = components(edges)
    return of, settled(component_links(groups, of), "links")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. `vectors`: vec_id, embedding, label."""
    rows, groups = _classes(vectors)
    unsure, rooms, edges = groups, groups.select(F.col("class").alias("a"), F.lit(LIST).alias("room")), None
    for turn in range(TRIES):
        found, lists = descend(unsure, rooms, turn)
        edges = found if edges is None else edges.unionByName(found)
        of, links = _joined(groups, edges)
        unsure = settled(unsure.join(audit(unsure, links), "label", "left_semi"), "vectors")
        if unsure.isEmpty():
            break
        rooms = settled(enlarged(rooms, lists).join(unsure.select(F.col("class").alias("a")), "a", "left_semi"), "rooms")
    else:
        of, links = _joined(groups, edges.unionByName(label_edges(unsure)))
    known = groups.join(links, "class", "left").join(of.withColumnRenamed("node", "class"), "class", "left")
    known = settled(known.select("name", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component_id")), "known")
    linked = with_groups(rows.where("name is not null"), known, "name", "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("name is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))

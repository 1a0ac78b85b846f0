"""Near-duplicate vectors by a forest of random-projection trees with spill.

Each tree splits the vectors again and again by a random direction at the
median; vectors near the cut (``spill`` of the rows on either side) go to both
children, so close pairs are seldom parted, and the pairs that one tree parts
another keeps. Within a leaf every pair of equal label is compared exactly, in
double precision. A pair that meets in several leaves belongs to the first of
them, so links are counted once without sending pairs anywhere: a task returns
one number per vector and a spanning forest of its links.

A group much larger than a leaf would be halved until its pieces fit one. Such
groups are found on the sample the cuts are fitted on: a vector with very many
neighbours is a centre, the rows within the threshold of it are its core. Links
of core rows are exact: whatever links with one lies within twice the threshold's
angle of the centre, and these rows are compared whole, in pairs of blocks of
bounded size over many tasks. The trees hold the other rows only.

The directions are drawn from a seed; the cuts are fitted on a bounded sample
of the vectors. Every vector is indexed. Exact copies are met once, by their
smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, stored, width
from tessera.llm.simhash import Forest as Links

#: Vectors that the cuts are fitted on; a node with fewer of them than ``LEAST`` is not split.
SAMPLE = 20_000
LEAST = 48
#: A vector with so many leaves' rows as neighbours is the centre of a dense group; rows of a block of such a group.
DENSE_LEAVES = 4
DENSE_ROWS = 2_048
#: Rows of a leaf compared with the others at a time.
ROWS = 1_024
#: Leaf rows a task is sized for.
TASK_ROWS = 60_000


@dataclass(frozen=True)
class Tree:
    """Cuts in heap order: node ``i`` has children ``2i`` and ``2i + 1``; a node without a cut is a leaf."""

    directions: np.ndarray  # one row per depth
    cuts: dict[int, tuple[float, float, float]]  # node -> lower bound of the spill, cut, upper bound

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row of ``x`` falls into."""
        rows, nodes = np.arange(len(x)), np.ones(len(x), np.int64)
        out_rows, out_leaves = [], []
        for direction in self.directions:
            where = x @ direction
            bounds = np.array([self.cuts.get(int(n), (np.nan,) * 3) for n in np.unique(nodes)]).reshape(-1, 3)
            low, _, high = bounds[np.searchsorted(np.unique(nodes), nodes)].T
            done = np.isnan(low)
            out_rows.append(rows[done])
            out_leaves.append(nodes[done])
            left = ~done & (where[rows] < high)
            right = ~done & (where[rows] >= low)
            rows, nodes = (np.concatenate([rows[left], rows[right]]),
                           np.concatenate([nodes[left] * 2, nodes[right] * 2 + 1]))
        return np.concatenate([*out_rows, rows]), np.concatenate([*out_leaves, nodes])


def fit_tree(sample: np.ndarray, depth: int, spill: float, seed: int) -> Tree:
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((depth, sample.shape[1]))
    cuts: dict[int, tuple[float, float, float]] = {}
    level = {1: sample}
    for direction in directions:
        below = {}
        for node, own in level.items():
            if len(own) < LEAST:
                continue
            where = own @ direction
            low, cut, high = np.quantile(where, [0.5 - spill, 0.5, 0.5 + spill])
            if low == high:
                high = np.nextafter(high, np.inf)  # all alike: both children take them
            cuts[node] = (low, cut, high)
            below[2 * node], below[2 * node + 1] = own[where < high], own[where >= low]
        level = below
    return Tree(directions, cuts)


@dataclass(frozen=True)
class Dense:
    """Dense groups: a centre and a number of blocks each; ``rest`` marks the sample's rows outside every core."""

    centres: np.ndarray
    core: float  # least cosine to the centre of a core row, and of a row that can link with one
    halo: float
    blocks: np.ndarray
    rest: np.ndarray

    def cores(self, cosines: np.ndarray) -> np.ndarray:
        """First centre whose core holds each row; the number of centres for none."""
        return np.argmax(np.column_stack([cosines >= self.core, np.ones(len(cosines), bool)]), axis=1)


def fit_dense(sample: np.ndarray, n: int, threshold: float, leaf: int) -> Dense:
    """Centres until no vector of the sample has ``DENSE_LEAVES`` leaves' rows as neighbours outside the cores."""
    many = max(LEAST, DENSE_LEAVES * leaf * len(sample) / max(1, n))
    angle = math.acos(min(1.0, max(-1.0, threshold)))
    core, halo = math.cos(angle), math.cos(min(math.pi, 2 * angle)) - 1e-6
    open_, degree = np.ones(len(sample), bool), np.zeros(len(sample), np.int64)

    def neighbours(of: np.ndarray) -> np.ndarray:
        return np.concatenate([(sample[low : low + ROWS] @ of.T >= core).sum(axis=1)
                               for low in range(0, len(sample), ROWS)]) if len(sample) else degree

    if len(sample) > many:
        degree = neighbours(sample)
    centres, blocks = [], []
    while open_.any():
        at = int(np.argmax(np.where(open_, degree, -1)))
        if degree[at] <= many:
            break
        own = open_ & (sample @ sample[at] >= core)
        own[at] = True
        centre = sample[at]
        mean = sample[own].sum(axis=0)
        if np.linalg.norm(mean) > 1e-6:
            mean = mean / np.linalg.norm(mean)
            around = open_ & (sample @ mean >= core)
            if around.sum() >= own.sum():
                centre, own = mean, around
        met = int((open_ & (sample @ centre >= halo)).sum())
        centres.append(centre)
        blocks.append(max(1, math.ceil(met * n / len(sample) / DENSE_ROWS)))
        open_ &= ~own
        degree = degree - neighbours(sample[own])
    return Dense(np.array(centres).reshape(len(centres), sample.shape[1]), core, halo,
                 np.array(blocks, np.int64), open_)


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & numbers & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of large components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(x: np.ndarray, copies: np.ndarray, cells: list[np.ndarray], cell: int,
            threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, weighted by copies; component labels) among the rows of one leaf and label.

    ``cells`` lists all leaves of each row, by number; pairs that share an earlier leaf than ``cell`` belong there.
    """
    earlier = [c[c < cell] for c in cells]
    known, flat = np.unique(np.concatenate(earlier), return_inverse=True) if len(x) else (np.zeros(0), [])
    member = np.zeros((len(x), len(known)), bool)
    member[np.repeat(np.arange(len(x)), [len(e) for e in earlier]), flat] = True
    bits = np.packbits(member, axis=1)
    links, joined = np.zeros(len(x), np.int64), Links(len(x))
    for low in range(0, len(x), ROWS):
        a, b = np.nonzero(x[low : low + ROWS] @ x.T >= threshold)
        a = a + low
        a, b = a[a < b], b[a < b]
        for start in range(0, len(a), 500_000):
            i, j = a[start : start + 500_000], b[start : start + 500_000]
            own = ~(bits[i] & bits[j]).any(axis=1)
            i, j = i[own], j[own]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            joined.link(i, j)
    return links, joined.root


def compare_blocks(x: np.ndarray, copies: np.ndarray, inner: np.ndarray, side: np.ndarray, same: bool,
                   threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The same among the rows of two blocks of a dense group, or of one (``same``).

    A pair is met here if one of its rows is in the group's core (``inner``).
    """
    links, joined = np.zeros(len(x), np.int64), Links(len(x))
    left, right = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(side == side.min()),
                                                         np.flatnonzero(side != side.min()))
    for low in range(0, len(left), ROWS):
        rows = left[low : low + ROWS]
        hit = (x[rows] @ x[right].T >= threshold) & (inner[rows][:, None] | inner[right])
        if same:
            hit &= rows[:, None] < right
        links[rows] += np.rint(hit @ copies[right].astype(np.float64)).astype(np.int64)
        links[right] += np.rint(copies[rows].astype(np.float64) @ hit).astype(np.int64)
        while True:  # one link of each row that leads to another component
            hit &= joined.root[rows][:, None] != joined.root[right]
            first = hit.argmax(axis=1)
            some = hit[np.arange(len(rows)), first]
            if not some.any():
                break
            joined.link(rows[some], right[first[some]])
    return links, joined.root


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = 0.93, trees: int = 8, leaf: int = 400,
                    spill: float = 0.08, seed: int = 17) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows link if their labels are equal, their vectors have the same length and a cosine of at least
    ``threshold``. Null, zero and non-finite vectors, null labels and null ids link with nothing; a null
    id gives a null component and is not kept. Repeated rows are vectors of their own and link as copies.
    Other columns are not read; an empty table gives no rows. ``leaf`` is the number of rows a leaf is
    sized for; a leaf that grows beyond it (many alike vectors) is still compared whole, in blocks. Groups of
    more than about ``DENSE_LEAVES`` leaves of mutual neighbours are no tree's business but compared exactly.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"),
                         F.col(label_col).alias("label"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x"))
    key = [F.xxhash64("label", "x"), F.xxhash64(F.lit(1), "x", "label")]
    rows = own.select("id", F.when(good, key[0]).alias("k1"), F.when(good, key[1]).alias("k2"))
    classes = own.where(good).withColumns({"k1": key[0], "k2": key[1]}).groupBy("k1", "k2").agg(
        F.min(F.col("id").cast("long")).alias("rep"), F.count("*").alias("copies"),
        F.first("label").alias("label"), F.first("x").alias("x"))
    classes = stored(classes, "vectors")
    sizes = classes.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).collect()  # a row per vector length
    parts = [_leaf_links(classes.where(F.size("x") == r["dim"]), r["dim"], r["n"], threshold, trees, leaf, spill, seed)
             for r in sizes]
    if parts:
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        found = stored(found, "vector-links")
        links = found.groupBy("u").agg(F.sum("n").alias("n"))
        joined = components(found.where("v IS NOT NULL"), "vector-components")
        linked = classes.select("k1", "k2", "rep", "copies").join(links, F.col("rep") == links.u, "left").join(
            joined, F.col("rep") == joined.node, "left")
    else:
        linked = classes.select("k1", "k2", "rep", "copies").withColumns(
            {"n": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    linked = linked.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"),
                           (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                           F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(linked, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.coalesce("component_id", F.col("id").cast("long"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("id").cast("long") == component, F.lit(False)).alias("kept"))


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Non-negative scattered numbers of the ids."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(33)).astype(np.int64)


def _cut(batch: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, at: np.ndarray, offsets: np.ndarray,
         values: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of the batch with their cells, and the lists that they have ``at`` the given places, some at a time."""
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
    for low in range(0, len(row), 20_000):
        part = pa.array(row[low : low + 20_000])
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell[low : low + 20_000], pa.int64()), batch.column(0).take(part), batch.column(1).take(part),
             batch.column(2).take(part), batch.column(3).take(part), lists.take(pa.array(at[low : low + 20_000]))], names)


def _leaf_links(classes: DataFrame, dim: int, n: int, threshold: float, trees: int, leaf: int, spill: float,
                seed: int) -> DataFrame:
    """(u, v, n): rows (u, null, links) and rows (u, v, null) of a spanning forest, over all leaves."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("rep"), "rep").select("x").limit(SAMPLE).toArrow()
    x = _unit(sample.column("x").combine_chunks())
    dense = fit_dense(x, n, threshold, leaf) if n > DENSE_LEAVES * leaf else fit_dense(x[:0], 0, threshold, leaf)
    rest = x[dense.rest] if len(dense.centres) else x
    n_rest = math.ceil(n * len(rest) / max(1, len(x)))
    depth = max(0, math.ceil(math.log2(n_rest / leaf))) if n_rest > leaf else 0
    sent = spark.sparkContext.broadcast(  # cuts of a sample
        ([fit_tree(rest, depth, spill, seed + t) for t in range(trees)], dense))
    stride = 1 << (depth + 1)
    base = trees * stride + np.concatenate([[0], np.cumsum(dense.blocks ** 2)])  # first cell of each dense group

    def deal(batches):
        names = ["cell", "label", "rep", "copies", "x", "cells"]
        forest, dense = sent.value
        for batch in batches:
            unit = _unit(batch.column(3))
            cosines = unit @ dense.centres.T
            core = dense.cores(cosines)
            outside = np.flatnonzero(core == len(dense.centres))
            found = [(outside[r], t * stride + c) for t, (r, c) in enumerate(tree.leaves(unit[outside])
                                                                             for tree in forest)]
            row, cell = np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])
            order = np.lexsort((cell, row))
            row, cell = row[order], cell[order]
            yield from _cut(batch, row, cell, row, np.concatenate(
                [[0], np.cumsum(np.bincount(row, minlength=len(batch)))]), cell, names)
            salt = _mixed(batch.column(1).to_numpy())
            for k, blocks in enumerate(dense.blocks.tolist()):
                # a pair belongs to the first core that one of its rows is in
                row = np.flatnonzero((cosines[:, k] >= dense.halo) & (core >= k))
                own = salt[row] % blocks
                lists = np.column_stack([core[row], own]).ravel()
                for low in range(0, len(row), max(1, 20_000 // blocks)):
                    at = np.repeat(np.arange(low, min(len(row), low + max(1, 20_000 // blocks))), blocks)
                    other = np.tile(np.arange(blocks), len(at) // blocks)
                    pair = np.minimum(own[at], other) * blocks + np.maximum(own[at], other)
                    yield from _cut(batch, row[at], base[k] + pair, at, np.arange(len(row) + 1) * 2, lists, names)

    label_type = classes.schema["label"].dataType.simpleString()
    dealt = classes.select("label", "rep", "copies", "x").mapInArrow(
        deal, f"cell long, label {label_type}, rep long, copies long, x array<double>, cells array<long>")
    met = sum(b * b * DENSE_ROWS for b in dense.blocks.tolist())
    tasks = width(spark, int(n_rest * trees * (1 + 2 * spill) ** depth) + met, TASK_ROWS)
    dealt = dealt.repartition(tasks, "cell", "label").sortWithinPartitions("cell", "label", "rep")

    dense_blocks = dense.blocks

    def solve(table: pa.Table) -> pa.RecordBatch:
        rep = table.column("rep").to_numpy()
        cells = np.split(table.column("cells").combine_chunks().flatten().to_numpy(),
                         np.cumsum([len(c) for c in table.column("cells")])[:-1])
        unit, copies = _unit(table.column("x").combine_chunks()), table.column("copies").to_numpy()
        cell = table.column("cell")[0].as_py()
        if cell < base[0]:
            links, root = compare(unit, copies, cells, cell, threshold)
        else:
            k = int(np.searchsorted(base, cell, "right")) - 1
            a, b = divmod(cell - int(base[k]), int(dense_blocks[k]))
            core, side = np.array(cells).T
            if a != b and (side == side[0]).all():  # only one of the two blocks has rows of this label
                links, root = np.zeros(len(unit), np.int64), np.arange(len(unit))
            else:
                links, root = compare_blocks(unit, copies, core == k, side, a == b, threshold)
        some, tied = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
        u = np.concatenate([rep[some], rep[tied]])
        v = pa.array([None] * len(some) + rep[root[tied]].tolist(), pa.int64())
        count = pa.array(links[some].tolist() + [None] * len(tied), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), v, count], ["u", "v", "n"])

    def search(batches):
        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held else pa.Table.from_batches([batch])
            cell, label = held.column("cell").to_numpy(), held.column("label").to_numpy()
            new = np.flatnonzero((cell[1:] != cell[:-1]) | (label[1:] != label[:-1])) + 1
            edges = [0, *new.tolist()]
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    yield solve(held.slice(a, b - a))
            held = held.slice(edges[-1])
        if held and len(held) > 1:
            yield solve(held)

    return dealt.mapInArrow(search, "u long, v long, n long")

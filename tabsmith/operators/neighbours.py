"""Exact k-nearest-neighbour search in boxes, for rows of any width.

Distance between two rows: mean squared difference over the features both
have, times the number of features, square root. A row is one array column, so
the plan is the same for two features as for hundreds.

1. Equal rows are merged on both sides, so a group of copies is one row.
2. Donors are cut into cells: the widest feature at its median, again and again,
   rows without the feature in a cell of their own. The cuts come from a bounded
   sample and decide speed only; each cell's box comes from all its donors.
3. A receiver looks into its own cell, then into the nearest ones, until they hold
   k donors. The k-th distance found bounds how far a better donor can be.
4. Every further cell whose box is within the bound is searched; the result is
   exact. Such cells are found from the tree's root downwards, so a receiver
   does not meet all boxes.

A cell and its visitors meet in blocks of bounded size. A block is cut into
leaves in the same way, and a receiver is compared by matrix products with the
leaves within its bound; what may belong to the nearest is measured again term
by term. Ties
are ordered by the donor's values in the order of the features, so no row
identity is needed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabsmith.functions.columns import col
from tabsmith.session import materialise

#: Donors of a cell that are wanted, and the most cells: all boxes together hold at most this many sides.
CELL_ROWS, BOX_SIDES = 2048, 1 << 18
#: Donors and receivers that meet at a time, and the donors of a leaf that are compared at once.
DONOR_BLOCK, RECEIVER_BLOCK, LEAF_ROWS = 4096, 8192, 64
#: Donors that the cuts are taken from.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 1 << 21
SLACK = 1 + 1e-9


def vector(columns: list[Column]) -> Column:
    """Columns as one array; values that are not finite count as missing."""
    numbers = [c.cast("double") for c in columns]
    return F.array(*[F.when(F.abs(c) < F.lit(float("inf")), c) for c in numbers])


class BoxTree:
    """Cuts of a sample: at a node a feature and a value, below, above and, for rows without it, aside."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.feature, self.cut, self.next, self.cell = [-1], [0.0], [[-1, -1, -1]], [0]
        queue = [(-len(sample), 0, np.arange(len(sample)))]
        leaves = 1
        while queue and leaves < cells:
            _, node, rows = heapq.heappop(queue)
            found = self._divide(sample[rows])
            if found is None:
                continue
            self.feature[node], self.cut[node], sides = found
            first = True
            for side in range(3):
                part = rows[sides == side]
                if len(part):
                    self.next[node][side] = len(self.feature)
                    heapq.heappush(queue, (-len(part), len(self.feature), part))
                    self.feature.append(-1)
                    self.cut.append(0.0)
                    self.next.append([-1, -1, -1])
                    self.cell.append(self.cell[node] if first else leaves)
                    leaves += not first
                    first = False
        self.cells = leaves
        self.feature, self.cut, self.next, self.cell = map(np.array, (self.feature, self.cut, self.next, self.cell))

    @staticmethod
    def _divide(x: np.ndarray):
        """(feature, value, side of each row), or None where all rows are alike."""
        there = ~np.isnan(x)
        share = there.mean(axis=0)
        with np.errstate(all="ignore"):
            low, high = np.fmin.reduce(x, axis=0), np.fmax.reduce(x, axis=0)
            spread = np.where(share > 0, high - low, 0.0) * share
        f = int(np.argmax(spread))
        if not spread[f] > 0:
            f = int(np.argmax(share * (1 - share)))
            if not 0 < share[f] < 1:
                return None
            return f, np.inf, np.where(there[:, f], 0, 2)
        values = np.sort(x[there[:, f], f])
        cut = values[(len(values) - 1) // 2]
        if cut == values[-1]:
            cut = values[np.searchsorted(values, cut) - 1]
        return f, cut, np.where(there[:, f], x[:, f] > cut, 2).astype(int)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row; a row that lacks a feature no sampled row lacked goes below the cut."""
        node = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.cell[node]
            at = node[inner]
            value = x[inner, f[inner]]
            side = np.where(np.isnan(value), 2, value > self.cut[at])
            to = self.next[at, side]
            for other in (0, 1, 2):
                to = np.where(to < 0, self.next[at, other], to)
            node[inner] = to


class Boxes:
    """The box of each cell: its bounds per feature and whether some or all of its donors have the feature."""

    def __init__(self, low: np.ndarray, high: np.ndarray, some: np.ndarray, every: np.ndarray):
        self.low, self.high, self.some, self.every = low, high, some, every

    @staticmethod
    def of(cell: np.ndarray, x: np.ndarray, cells: int) -> Boxes:
        """The boxes of rows that are at hand."""
        low, high = np.zeros((cells, x.shape[1])), np.zeros((cells, x.shape[1]))
        some, every = np.zeros(low.shape, bool), np.zeros(low.shape, bool)
        order = np.argsort(cell, kind="stable")
        at, first = np.unique(cell[order], return_index=True)
        x = x[order]
        low[at], high[at] = np.fmin.reduceat(x, first), np.fmax.reduceat(x, first)
        some[at], every[at] = np.logical_or.reduceat(~np.isnan(x), first), np.logical_and.reduceat(~np.isnan(x), first)
        return Boxes(low, high, some, every)

    def above(self, tree: BoxTree) -> Boxes:
        """The box of each node of the tree: that of its cell, or what holds all boxes below it."""
        count, d = len(tree.feature), self.low.shape[1]
        up = Boxes(np.zeros((count, d)), np.zeros((count, d)), np.zeros((count, d), bool), np.zeros((count, d), bool))
        for node in reversed(range(count)):
            if tree.feature[node] < 0:
                up._put(node, self, [tree.cell[node]])
            else:
                # Cells without donors say nothing; a node comes before those below it.
                up._put(node, up, [n for n in tree.next[node] if n >= 0 and up.some[n].any()])
        return up

    def _put(self, at: int, other: Boxes, rows: list) -> None:
        if len(rows):
            self.low[at], self.high[at] = other.low[rows].min(axis=0), other.high[rows].max(axis=0)
            self.some[at], self.every[at] = other.some[rows].any(axis=0), other.every[rows].all(axis=0)

    def pairs(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The bound of `least` for one box per row."""
        there = ~np.isnan(x)
        shared = (there & self.some[at]).sum(axis=1)
        gap = np.maximum(np.maximum(self.low[at] - x, x - self.high[at]), 0.0)
        total = (np.where(self.every[at] & there, gap, 0.0) ** 2).sum(axis=1)
        return np.where(shared > 0, total * x.shape[1] / np.maximum(shared, 1), np.inf)

    def least(self, x: np.ndarray) -> np.ndarray:
        """A lower bound of the squared distance of each row to each cell; infinite where none is comparable."""
        there = ~np.isnan(x)
        shared = there.astype(float) @ self.some.T.astype(float)
        total = np.zeros((len(x), len(self.low)))
        for f in np.flatnonzero(self.every.any(axis=0) & there.any(axis=0)):
            v = x[:, f, None]
            gap = np.maximum(np.maximum(self.low[:, f] - v, v - self.high[:, f]), 0.0)
            total += np.where(self.every[:, f] & there[:, f, None], gap, 0.0) ** 2
        return np.where(shared > 0, total * x.shape[1] / np.maximum(shared, 1), np.inf)


def _matrix(column, d: int) -> np.ndarray:
    """An Arrow column of arrays of one length as rows; null elements become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _tree(pool: DataFrame, size: int, d: int, cell_rows: int) -> BoxTree:
    cells = max(1, min(-(-size // cell_rows), BOX_SIDES // d))
    if cells == 1:
        return BoxTree(np.zeros((0, d)), 1)
    most = min(SAMPLE_ROWS, SAMPLE_VALUES // d)
    picked = pool.select("x").orderBy(F.xxhash64("x"), "x").limit(most).collect()
    return BoxTree(np.array([[np.nan if v is None else v for v in r["x"]] for r in picked], float), cells)


def _boxes(placed: DataFrame, cells: int, d: int) -> Boxes:
    """Every task adds up the boxes of its donors; one row per cell and task leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((cells, d), np.nan), np.full((cells, d), np.nan)
        some, every, seen = np.zeros((cells, d), bool), np.ones((cells, d), bool), np.zeros(cells, bool)
        for b in batches:
            cell, x = b.column("cell").to_numpy(), _matrix(b.column("x"), d)
            order = np.argsort(cell, kind="stable")
            at, first = np.unique(cell[order], return_index=True)
            if not len(at):
                continue
            x, seen[at] = x[order], True
            low[at] = np.fmin(low[at], np.fmin.reduceat(x, first))
            high[at] = np.fmax(high[at], np.fmax.reduceat(x, first))
            some[at] |= np.logical_or.reduceat(~np.isnan(x), first)
            every[at] &= np.logical_and.reduceat(~np.isnan(x), first)
        at = np.flatnonzero(seen)
        lists = [pa.array(list(a[at]), pa.list_(t)) for a, t in ((low, pa.float64()), (high, pa.float64()), (some, pa.bool_()), (every, pa.bool_()))]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *lists], names=["cell", "low", "high", "some", "every"])

    kinds = "cell int, low array<double>, high array<double>, some array<boolean>, every array<boolean>"
    parts = placed.select("cell", "x").mapInArrow(run, kinds)
    # Merged per cell and feature, so that no more than all sides of all boxes come to the driver.
    flat = parts.select("cell", F.posexplode(F.arrays_zip("low", "high", "some", "every")).alias("f", "s"))
    value = lambda name: F.when(~F.isnan(F.col(f"s.{name}")), F.col(f"s.{name}"))
    merged = flat.groupBy("cell", "f").agg(
        F.min(value("low")).alias("low"), F.max(value("high")).alias("high"), F.max("s.some").alias("some"), F.min("s.every").alias("every")
    )
    low, high = np.zeros((cells, d)), np.zeros((cells, d))
    some, every = np.zeros((cells, d), bool), np.zeros((cells, d), bool)
    for r in merged.collect():
        i = r["cell"], r["f"]
        low[i], high[i], some[i], every[i] = r["low"] or 0.0, r["high"] or 0.0, r["some"], r["every"]
    return Boxes(low, high, some, every)


def _within(x: np.ndarray, far: np.ndarray, tree: BoxTree, up: Boxes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, cells) of all cells within `far` of each row, from the root downwards, some pairs at a time."""
    most = max(1, (1 << 20) // x.shape[1])
    waiting = [(np.arange(len(x)), np.zeros(len(x), np.int64))]
    while waiting:
        row, node = waiting.pop()
        if len(row) > most:
            waiting += [(row[most:], node[most:]), (row[:most], node[:most])]
            continue
        least = up.pairs(x[row], node)
        near = (least <= far[row] ** 2 * SLACK) & np.isfinite(least)
        row, node = row[near], node[near]
        leaf = tree.feature[node] < 0
        if leaf.any():
            yield row[leaf], tree.cell[node[leaf]]
        to = tree.next[node[~leaf]]
        if len(to):
            waiting.append((np.repeat(row[~leaf], 3)[to.ravel() >= 0], to[to >= 0]))


def _visits(asked: DataFrame, tree: BoxTree, boxes: Boxes, d: int, before: int, reach: int | None) -> DataFrame:
    """(cell, id, x, wanted, bounds, reach): each receiver with the cells that it looks into next.

    For a reach of 1 that is its own cell, for a larger one the `reach` nearest,
    for None all within its widest bound. Cells that it has seen are left out:
    its own and the `before` nearest, or as many as its own `reach` says.
    """
    up = boxes.above(tree) if reach is None else None

    def seen(x: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Numbers of row and cell for what rows have seen of the nearest cells."""
        found = [np.zeros(0, np.int64)]
        step = max(1, (1 << 20) // max(len(boxes.low), d))
        for n in np.unique(upto[upto > 1]):
            wide = np.flatnonzero(upto == n)
            for low in range(0, len(wide), step):
                rows = wide[low : low + step]
                order = np.argsort(boxes.least(x[rows]), axis=1, kind="stable")[:, :n]
                found.append((rows[:, None] * tree.cells + order).ravel())
        return np.concatenate(found)

    def further(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x = _matrix(part.column("x"), d)
        own = tree.place(x)
        if reach == 1:
            yield np.arange(len(x)), own
        elif reach is not None:
            step = max(1, (1 << 20) // max(len(boxes.low), d))
            for low in range(0, len(x), step):
                least = boxes.least(x[low : low + step])
                cell = np.argsort(least, axis=1, kind="stable")[:, before if before > 1 else 0 : reach]
                row = np.repeat(np.arange(len(least)), cell.shape[1])
                cell = cell.ravel()
                new = np.isfinite(least[row, cell]) & (cell != own[low + row])
                yield low + row[new], cell[new]
        else:
            far = np.array([np.inf if None in v else max(v) for v in part.column("bounds").to_pylist()])
            upto = part.column("reach").to_numpy()
            at = np.flatnonzero(upto < tree.cells)
            x, own, far, upto = x[at], own[at], far[at], upto[at]
            known = seen(x, upto)
            for row, cell in _within(x, far, tree, up):
                new = ((upto[row] == 0) | (cell != own[row])) & ~np.isin(row * tree.cells + cell, known)
                yield at[row[new]], cell[new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, cell in further(b):
                for low in range(0, len(row), 4096):
                    taken = b.take(pa.array(row[low : low + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[low : low + 4096].astype(np.int32)), *taken.columns], names=["cell", *taken.schema.names])

    return asked.mapInArrow(run, "cell int, id long, x array<double>, wanted array<int>, bounds array<double>, reach int")


def _nearest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rank: np.ndarray, k: int, far: np.ndarray):
    """(row of x, row of y, distance) of each row's k nearest, copies counted, none beyond `far`; y is compared whole."""
    d = x.shape[1]
    mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    # About the mean of y, for products lose digits against the size of what they multiply.
    middle = np.nan_to_num(y).sum(axis=0) / np.maximum(my.sum(axis=0), 1)
    x0, y0 = np.nan_to_num(x - middle), np.nan_to_num(y - middle)
    shared = mx @ my.T
    scale = np.where(shared > 0, d / np.maximum(shared, 1), np.inf)
    rough = (x0**2) @ my.T + mx @ (y0**2).T - 2 * x0 @ y0.T
    rough = np.where(shared > 0, np.maximum(rough, 0.0) * scale, np.inf)
    # Allow for the digits that are lost before measuring again.
    loss = 1e-14 * d * d * ((x0**2).sum(axis=1) + (y0**2).sum(axis=1).max(initial=0.0))
    limit = far**2 * SLACK
    if y.shape[0] > k:
        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + loss)
    i, j = np.nonzero((rough <= (limit + loss)[:, None]) & np.isfinite(rough))
    out_i, out_j, out_d = [], [], []
    for low in range(0, len(i), max(1, (1 << 22) // d)):
        a, b = i[low : low + max(1, (1 << 22) // d)], j[low : low + max(1, (1 << 22) // d)]
        square = np.cumsum(np.nan_to_num(x[a] - y[b]) ** 2, axis=1)[:, -1]
        out_i.append(a), out_j.append(b), out_d.append(np.sqrt(square * float(d) / shared[a, b]))
    if not out_i:
        return i, j, np.zeros(0)
    return _first(i, j, np.concatenate(out_d), weight, rank, k, far)


def _first(i: np.ndarray, j: np.ndarray, dist: np.ndarray, weight: np.ndarray, rank: np.ndarray, k: int, far: np.ndarray):
    """In order, the k nearest of the pairs of each row, copies counted, none beyond `far`."""
    order = np.lexsort((rank[j], dist, i))
    i, j, dist = i[order], j[order], dist[order]
    upto = np.cumsum(weight[j])
    start = np.searchsorted(i, i)
    before = upto - weight[j] - np.where(start > 0, upto[start - 1], 0)
    kept = (before < k) & (dist <= far[i] * SLACK)
    return i[kept], j[kept], dist[kept]


def _kth(rows: int, i: np.ndarray, dist: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The distance of each row's last donor, infinite where there are fewer than k."""
    held, last = np.zeros(rows), np.zeros(rows)
    np.add.at(held, i, weight)
    np.maximum.at(last, i, dist)
    return np.where(held >= k, last, np.inf)


def _nearest_leaves(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rank: np.ndarray, k: int, far: np.ndarray):
    """The same as `_nearest`, for many rows: y is cut into leaves, and only those within a row's bound are compared with it.

    A row without a bound takes one from its own leaf, if that has k donors.
    """
    tree = BoxTree(y, -(-len(y) // LEAF_ROWS))
    if tree.cells == 1:
        return _blocks(x, y, weight, rank, k, far)
    leaf, own = tree.place(y), tree.place(x)
    order = np.argsort(leaf, kind="stable")
    ends = np.searchsorted(leaf[order], np.arange(tree.cells + 1))
    boxes, far, parts = Boxes.of(leaf, y, tree.cells), far.copy(), []

    def compare(row: np.ndarray, cell: np.ndarray) -> None:
        """Rows with a leaf each."""
        by = np.argsort(cell, kind="stable")
        row, cuts = row[by], np.searchsorted(cell[by], np.arange(tree.cells + 1))
        for c in np.unique(cell):
            rows, donors = row[cuts[c] : cuts[c + 1]], order[ends[c] : ends[c + 1]]
            i, j, dist = _blocks(x[rows], y[donors], weight[donors], rank[donors], k, far[rows])
            parts.append((rows[i], donors[j], dist))

    without = np.flatnonzero(np.isinf(far))
    compare(without, own[without])
    if parts:
        i, j, dist = (np.concatenate(p) for p in zip(*parts))
        far = np.minimum(far, _kth(len(x), i, dist, weight[j], k))
    first = np.zeros(len(x), bool)
    first[without] = True
    step = max(1, (1 << 21) // tree.cells)
    for low in range(0, len(x), step):
        least = boxes.least(x[low : low + step])
        row, cell = np.nonzero((least <= (far[low : low + step] ** 2 * SLACK)[:, None]) & np.isfinite(least))
        row += low
        new = ~first[row] | (cell != own[row])
        compare(row[new], cell[new])
    i, j, dist = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return _first(i, j, dist, weight, rank, k, far)


def _blocks(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rank: np.ndarray, k: int, far: np.ndarray):
    """`_nearest` for some rows of x at a time."""
    step = max(1, (1 << 21) // max(len(y), 1))
    parts = []
    for low in range(0, max(len(x), 1), step):
        i, j, dist = _nearest(x[low : low + step], y, weight, rank, k, far[low : low + step])
        parts.append((i + low, j, dist))
    return tuple(np.concatenate(p) for p in zip(*parts))


FOUND = "id long, g int, dist double, rank long, w long, far double, chosen array<double>"


def _search(visits: DataFrame, placed: DataFrame, sizes: DataFrame, k: int, d: int) -> DataFrame:
    """Per receiver and group the nearest donors of each block that it meets, with the distance of
    the k-th one (`far`), if there are so many.

    Donors and visitors of a cell are dealt into blocks by hash, and every two
    blocks of a cell meet in a group of their own, so no group is unbounded.
    """
    visits = materialise(visits, "visits")
    asked = visits.groupBy("cell").agg(F.count("*").alias("visitors"))
    # One row per cell.
    plan = sizes.join(asked, "cell").select(
        "cell", F.ceil(F.col("donors") / DONOR_BLOCK).cast("int").alias("db"), F.ceil(F.col("visitors") / RECEIVER_BLOCK).cast("int").alias("rb")
    )
    plan = F.broadcast(materialise(plan, "cells"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = visits.drop("reach").join(plan, "cell").withColumn("r", F.pmod(F.xxhash64("id"), F.col("rb")).cast("int")).withColumn("b", spread(F.col("db"))).drop("db", "rb")
    right = placed.join(plan, "cell").withColumn("b", F.pmod(F.xxhash64("rank"), F.col("db")).cast("int")).withColumn("r", spread(F.col("rb"))).drop("db", "rb")

    def run(receivers: pa.Table, donors: pa.Table) -> pa.Table:
        parts = []
        if receivers.num_rows and donors.num_rows:
            x, y = _matrix(receivers.column("x"), d), _matrix(donors.column("x"), d)
            ids = receivers.column("id").to_numpy()
            wanted, bounds = receivers.column("wanted").to_pylist(), receivers.column("bounds").to_pylist()
            weight, rank = donors.column("w").to_numpy(), donors.column("rank").to_numpy()
            choices = donors.column("choices").to_pylist()
            asked: dict[int, list[tuple[int, float]]] = {}
            for i, (gs, fars) in enumerate(zip(wanted, bounds)):
                for g, far in zip(gs, fars):
                    asked.setdefault(g, []).append((i, np.inf if far is None else far))
            for g, rows in asked.items():
                has = np.array([j for j, c in enumerate(choices) if c[g] is not None], np.int64)
                if not len(has):
                    continue
                at, far = np.array([i for i, _ in rows]), np.array([f for _, f in rows])
                # Cutting the donors costs about as much as comparing a leaf of receivers with all of them.
                search = _nearest_leaves if min(len(rows), len(has)) > LEAF_ROWS else _blocks
                i, j, dist = search(x[at], y[has], weight[has], rank[has], k, far)
                chosen = [choices[m][g] for m in has[j]]
                kth = _kth(len(at), i, dist, weight[has[j]], k)[i]
                parts.append((ids[at[i]], np.full(len(i), g, np.int32), dist, rank[has[j]], weight[has[j]], kth, chosen))
        names = ["id", "g", "dist", "rank", "w", "far"]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
        columns = [pa.array(np.concatenate([p[n] for p in parts]) if parts else [], t) for n, t in enumerate(kinds)]
        columns[5] = pc.if_else(pc.is_inf(columns[5]), None, columns[5])
        columns.append(pa.array([c for p in parts for c in p[6]], pa.list_(pa.float64())))
        return pa.table(columns, names=[*names, "chosen"])

    keys = ["cell", "r", "b"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, FOUND)


def _taken(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of all blocks, with how many of them a row counts for (`t`)."""
    earlier = W.partitionBy("id", "g").orderBy("dist", "rank").rowsBetween(W.unboundedPreceding, -1)
    left = k - F.coalesce(F.sum("w").over(earlier), F.lit(0))
    return found.withColumn("t", F.least(F.col("w"), left)).filter("t > 0")


def _bounded(asked: DataFrame, kth: DataFrame) -> DataFrame:
    """Receivers with their `far` per wanted group; null where there is none."""
    per = kth.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("g", "far"))).alias("_far"))
    joined = asked.drop("bounds").join(per, "id", "left")
    far = F.transform("wanted", lambda g: F.try_element_at("_far", g))
    return joined.select("id", "x", "wanted", far.alias("bounds"), "reach")


def nearest(receivers: DataFrame, donors: DataFrame, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k nearest donors of each distinct receiver and group.

    `receivers` have `x` (array of doubles, null where missing) and, unless it is
    the first one for all, `wanted` (numbers of the groups to search); `donors`
    have `x` of the same length and `choices`, per group an array of doubles or
    null where the donor can not serve the group. Returns x, g, chosen and t, the number of neighbours that
    a row stands for. Receivers without any comparable donor give no rows.
    """
    found, asked = _found(receivers, donors, k, cell_rows)
    return found.join(asked, "id").select("x", "g", "chosen", "t")


def _found(receivers: DataFrame, donors: DataFrame, k: int, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of `nearest` with the receiver's `id` in place of x, and (id, x)."""
    own = donors.select("x", "choices").groupBy("x", "choices").agg(F.count("*").alias("w"))
    some = lambda x: F.exists(x, lambda v: v.isNotNull())
    order = ["x", "choices"]
    pool = own.filter(some("x")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id())
    pool = materialise(pool, "donors")
    wanted = F.col("wanted") if "wanted" in receivers.columns else F.array(F.lit(0))
    asked = receivers.select("x", wanted.alias("wanted")).filter(some("x") & (F.size("wanted") > 0)).distinct()
    none = F.transform("wanted", lambda g: F.lit(None).cast("double"))
    asked = asked.withColumn("id", F.monotonically_increasing_id())
    asked = materialise(asked.select("id", "x", "wanted", none.alias("bounds"), F.lit(0).alias("reach")), "receivers")
    names = asked.select("id", "x")
    size, first = pool.count(), pool.select("x").first()
    if first is None:
        return asked.select("id", F.lit(0).alias("g"), F.array(F.lit(0.0)).alias("chosen"), F.lit(0).cast("long").alias("t")).limit(0), names
    d = len(first["x"])
    tree = _tree(pool, size, d, cell_rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = tree.place(_matrix(b.column("x"), d)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns], names=["cell", *b.schema.names])

    kinds = "cell int, x array<double>, choices array<array<double>>, w long, rank long"
    placed = materialise(pool.select("x", "choices", "w", "rank").mapInArrow(place, kinds), "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("donors"))
    boxes = _boxes(placed, tree.cells, d)
    # What is found is kept, so that no two rows meet twice.
    before, reach, open_rows, done, found = 0, 1, asked, None, None
    while tree.cells > 1:
        new = materialise(_search(_visits(open_rows, tree, boxes, d, before, reach), placed, sizes, k, d), "found")
        found = new if found is None else found.unionByName(new)
        if before == 0:
            # The k-th of one block bounds that of all, and needs no order.
            kth = new.filter("far is not null").groupBy("id", "g").agg(F.min("far").alias("far"))
        else:
            mine = _taken(found.join(open_rows.select("id"), "id", "left_semi"), k)
            kth = mine.groupBy("id", "g").agg(F.sum("t").alias("n"), F.max("dist").alias("far")).filter(F.col("n") >= k)
        now = materialise(_bounded(open_rows.withColumn("reach", F.lit(reach)), kth), "bounds")
        closed = F.forall("bounds", lambda b: b.isNotNull())
        # Receivers with fewer than k donors in all cells keep an open bound, and have seen them all.
        part = now.filter(closed)
        done = part if done is None else done.unionByName(part)
        if reach >= tree.cells or now.filter(~closed).isEmpty():
            break
        open_rows, before, reach = now.filter(~closed), reach, 8 * reach
    last = _search(_visits(asked if done is None else done, tree, boxes, d, 0, None), placed, sizes, k, d)
    return _taken(last if found is None else found.unionByName(last), k).select("id", "g", "chosen", "t"), names


def nearest_means(receivers: DataFrame, donors: DataFrame, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(x, g, means): per distinct receiver and group the means of the chosen values over the k nearest donors."""
    found, asked = _found(receivers, donors, k, cell_rows)
    spread = found.select("id", "g", "t", F.posexplode("chosen").alias("i", "v"))
    means = spread.groupBy("id", "g", "i").agg((F.sum(F.col("t") * F.col("v")) / F.sum("t")).alias("mean"))
    lists = means.groupBy("id", "g").agg(F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("m"))
    named = lists.join(asked, "id").select("x", "g", F.col("m.mean").alias("means"))
    # Equal receivers with other groups to search have an id each, and may share some groups.
    return named.groupBy("x", "g").agg(F.first("means").alias("means")) if "wanted" in receivers.columns else named


def nearest_votes(receivers: DataFrame, donors: DataFrame, k: int) -> DataFrame:
    """(x, vote): the value most common among the k nearest; the smallest one wins a tie.

    Votes are a grouped count, so any number of different values will do.
    """
    votes = nearest(receivers, donors, k).groupBy("x", F.get("chosen", F.lit(0)).alias("value")).agg(F.sum("t").alias("n"))
    won = votes.groupBy("x").agg(F.max(F.struct(F.col("n"), (-F.col("value")).alias("least"))).alias("won"))
    return won.select("x", (-F.col("won.least")).alias("vote"))


def impute_knn(df: DataFrame, columns: list[str], k: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Null cells become the mean over the k nearest rows that have the
    value, or the column mean where no row can be compared."""
    facts = df.agg(
        F.count("*").alias("rows"),
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)],
    ).first()
    k = k or min(5, max(2, facts["rows"] // 2))
    missing = [c for i, c in enumerate(columns) if facts[f"n{i}"] < facts["rows"]]
    if not missing:
        return df
    x = vector([col(c) for c in columns])
    choices = F.array(*[F.when(col(c).isNotNull(), F.array(col(c).cast("double"))) for c in missing])
    wanted = F.array_compact(F.array(*[F.when(col(c).isNull(), F.lit(i)) for i, c in enumerate(missing)]))
    found = nearest_means(df.select(x.alias("x"), wanted.alias("wanted")), df.select(x.alias("x"), choices.alias("choices")), k, cell_rows)
    value = F.struct("g", F.get("means", F.lit(0)).alias("v"))
    wide = found.groupBy("x").agg(F.map_from_entries(F.collect_list(value)).alias("_new")).withColumnRenamed("x", "_x")
    # Complete rows are passed by; only rows with gaps are moved and joined.
    gap = F.size(wanted) > 0
    joined = df.filter(gap).join(wide, x == F.col("_x"), "left")
    filled = {
        c: F.coalesce(col(c).cast("double"), F.try_element_at("_new", F.lit(i)), F.lit(facts[f"m{columns.index(c)}"]))
        for i, c in enumerate(missing)
    }
    mended = joined.select(*[filled.get(c, col(c)).alias(c) for c in df.columns])
    whole = df.filter(~gap).select(*[col(c).cast("double").alias(c) if c in missing else col(c) for c in df.columns])
    return whole.unionAll(mended)

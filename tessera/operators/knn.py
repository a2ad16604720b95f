"""Exact k-nearest-neighbour search over a sampled kd-tree, without a shuffle of neighbours.

A bounded sample of the reference rows is cut by medians into cells.  Query rows lie in blocks of neighbouring cells.

1. Home pass: a block's query rows are compared with the reference rows of its cells.  What is kept is one row per cell:
   the smallest box around its query rows and the largest of their k-th distances.
2. Last pass: a reference row goes to the blocks with a cell whose box is not farther from it than that cell's distance,
   so a block sees every row that can be a neighbour of one of its query rows.  The k nearest are found and used where
   the query row lies (``finish``); neighbours are neither written nor shuffled.

A block's reference rows are read as a stream, those of its own cells first, and compared in chunks, each under a small
tree of its own, so a task holds one block, its neighbours so far and one chunk.  A cell with many query rows is dealt
out to several blocks.  Distances are summed feature by feature in a fixed order and a box is never farther than a row
in it, in floating point too; ties break on the reference ids.  Rows without one of the features (NULL or NaN) are no
neighbours, and as queries have none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_ROWS = 2048                 # reference rows a cell is cut down to
BLOCK_ROWS = 32768               # query rows of one block at most
NEIGHBOURS = 1 << 20             # neighbours kept in one block at most
REF_BLOCK_ROWS = 1 << 16         # reference rows of one chunk
SAMPLE_ROWS = 1 << 18            # sampled reference rows the tree is cut from (on the driver)
CELLS = 1 << 16                  # distances computed at once (they stay in a core's cache)
FOUND = 1 << 21                  # neighbours held in a block before they are sorted
LEAST_WALK, MOST_WALK = 1 << 12, 1 << 17  # rows that walk through the tree together
TILE_ROWS = 128                  # reference rows of a leaf of a chunk's tree
NO_ID = -(1 << 62)               # stands for a missing reference id (sorts before all others)


# --------------------------------------------------------------------------- the tree

class Tree:
    """Median cuts: node i compares feature ``dim[i]`` with ``cut[i]``; a leaf has ``dim`` -1 and its number in ``leaf``."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, least: int):
        self.dim, self.cut, self.left, self.right, self.leaf, self.leaves = [], [], [], [], [], 0
        stack = [(sample, -1, False)]
        while stack:
            rows, parent, is_right = stack.pop()
            node = len(self.dim)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            dim, cut = self._median(rows, least) if len(rows) > leaf_rows else (-1, 0.0)
            self.dim.append(dim)
            self.cut.append(cut)
            self.left.append(-1)
            self.right.append(-1)
            self.leaf.append(self.leaves if dim < 0 else -1)
            if dim < 0:
                self.leaves += 1
            else:
                low = rows[:, dim] < cut
                stack += [(rows[~low], node, True), (rows[low], node, False)]
        self.dim, self.cut, self.leaf = np.array(self.dim), np.array(self.cut), np.array(self.leaf)
        self.left, self.right = np.array(self.left), np.array(self.right)

    @staticmethod
    def _median(rows: np.ndarray, least: int) -> tuple[int, float]:
        """Widest feature that a cut near its median divides into two parts of at least ``least`` rows."""
        for dim in np.argsort(-(rows.max(axis=0) - rows.min(axis=0)), kind="stable"):
            values = np.sort(rows[:, dim])
            middle = values[len(values) // 2]
            for cut in (middle, values[min(np.searchsorted(values, middle, "right"), len(values) - 1)]):
                low = np.searchsorted(values, cut)
                if min(low, len(values) - low) >= least:
                    return int(dim), float(cut)
        return -1, 0.0

    def home(self, points: np.ndarray) -> np.ndarray:
        """Leaf number of each point."""
        node = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.dim[node] >= 0)
            if not len(inner):
                return self.leaf[node]
            at = node[inner]
            node[inner] = np.where(points[inner, self.dim[at]] < self.cut[at], self.left[at], self.right[at])

    def boxes(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Boxes of all nodes from those of the leaves (children come after their node)."""
        lo, hi = np.full((len(self.dim), low.shape[1]), np.inf), np.full((len(self.dim), low.shape[1]), -np.inf)
        for i in range(len(self.dim) - 1, -1, -1):
            if self.dim[i] < 0:
                lo[i], hi[i] = low[self.leaf[i]], high[self.leaf[i]]
            else:
                lo[i] = np.minimum(lo[self.left[i]], lo[self.right[i]])
                hi[i] = np.maximum(hi[self.left[i]], hi[self.right[i]])
        return lo, hi

    def _walk(self, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, within) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for every leaf box that ``within(node, points, squared distances)`` accepts, as it does its nodes."""
        found, stack = [], [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            distance = np.zeros(len(rows))
            for j in range(points.shape[1]):
                x = points[rows, j]
                gap = np.maximum(np.maximum(lo[node, j] - x, x - hi[node, j]), 0.0)
                distance += gap * gap
            rows = rows[within(node, rows, distance)]
            if not len(rows):
                continue
            if self.dim[node] < 0:
                found.append((rows, np.full(len(rows), self.leaf[node])))
            else:
                stack += [(self.left[node], rows), (self.right[node], rows)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])

    def near(self, points: np.ndarray, bound: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for every leaf box at most ``bound`` (squared, one for each point) away from the point."""
        return self._walk(points, lo, hi, lambda node, rows, distance: distance <= bound[rows])

    def reach(self, points: np.ndarray, far: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for every leaf box at most ``far`` (squared, one for each node) away from the point."""
        return self._walk(points, lo, hi, lambda node, rows, distance: distance <= far[node])

    def upwards(self, far: np.ndarray) -> np.ndarray:
        """``far`` of all nodes, the largest of those of their leaves."""
        out = np.full(len(self.dim), -np.inf)
        for i in range(len(self.dim) - 1, -1, -1):
            out[i] = far[self.leaf[i]] if self.dim[i] < 0 else max(out[self.left[i]], out[self.right[i]])
        return out


# --------------------------------------------------------------------------- one block

class _Chunk:
    """Query rows against reference rows, both centred: |q|^2 + |r|^2 - 2 q.r, one matrix product, finds the candidates; its
    rounding error is far below the margin."""

    def __init__(self, points: np.ndarray, rows: np.ndarray, other: np.ndarray):
        self.points, self.rows, self.other = points, rows, other
        q, r = points - rows.mean(axis=0), rows - rows.mean(axis=0)
        qn, rn = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", r, r)
        self.left = np.column_stack([-2.0 * q, np.ones(len(q)), qn])
        self.right = np.column_stack([r, rn, np.ones(len(r))])
        self.margin = 16 * (points.shape[1] + 6) * np.finfo(float).eps * (qn + rn.max())

    def distances(self, some: np.ndarray, part: slice) -> np.ndarray:
        """Approximate squared distances of some points and the part's rows."""
        return self.left[some] @ self.right[part].T

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = np.zeros(len(i))
        for c in range(self.points.shape[1]):
            diff = self.points[i, c] - self.rows[j, c]
            d += diff * diff
        return d


def _in_order(rows: np.ndarray, dist: np.ndarray, r0: np.ndarray, r1: np.ndarray, ties: bool = True) -> np.ndarray:
    """Order by (row, distance, ids), without ``ties`` by (row, distance)."""
    order = np.argsort(dist)
    order = order[np.argsort(rows[order].astype(np.uint16 if len(rows) and rows.max() < 1 << 16 else np.int64), kind="stable")]
    same = (np.diff(rows[order]) == 0) & (np.diff(dist[order]) == 0)
    if ties and same.any():  # equal distances, in runs
        run = np.concatenate([[0], np.cumsum(~same)])
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        at = order[tied]
        order[tied] = at[np.lexsort((r1[at], r0[at], run[tied]))]
    return order


@dataclass
class Near:
    """The nearest rows of some query rows, nearest first, in as many columns as were asked for.  Entries from a row's
    ``have`` on are empty: distance inf, id -1, label 0."""
    have: np.ndarray
    dist: np.ndarray
    ids: np.ndarray
    y: np.ndarray


class _Block:
    """Query rows that see reference rows chunk by chunk; ``bound`` is a distance within which their k nearest lie.  Without
    ``ties`` only the distances of the k nearest are right, not which of equally distant rows they are."""

    def __init__(self, points: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, ties: bool = True):
        self.points, self.own, self.bound, self.k, self.ties, self.seen = points, own, bound.copy(), k, ties, False
        self.found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def see(self, rows: np.ndarray, other: np.ndarray, r0: np.ndarray, r1: np.ndarray, y: np.ndarray) -> None:
        tree = Tree(rows, max(2 * self.k, TILE_ROWS), self.k)
        leaf = tree.home(rows)
        order = np.argsort(leaf, kind="stable")
        edges = np.searchsorted(leaf[order], np.arange(tree.leaves + 1))
        chunk, r0, r1, y = _Chunk(self.points, rows[order], other[order]), r0[order], r1[order], y[order]
        if not self.seen:
            self._home(tree, chunk, edges)
            self.seen = True
        lo, hi = tree.boxes(np.minimum.reduceat(chunk.rows, edges[:-1]), np.maximum.reduceat(chunk.rows, edges[:-1]))
        at, cell = tree.near(self.points, self.bound, lo, hi)
        order = np.argsort(cell, kind="stable")
        at, cuts, pending = at[order], np.searchsorted(cell[order], np.arange(tree.leaves + 1)), 0
        for c in range(tree.leaves):
            part, wide = slice(edges[c], edges[c + 1]), edges[c + 1] - edges[c]
            for first in range(cuts[c], cuts[c + 1], step := max(1, CELLS // wide)):
                some = at[first:min(first + step, cuts[c + 1])]
                hit = np.flatnonzero(chunk.distances(some, part) <= (self.bound[some] + chunk.margin[some])[:, None])
                i, j = some[hit // wide], edges[c] + hit % wide
                keep = self.own[i] != chunk.other[j]
                i, j = i[keep], j[keep]
                d = chunk.exact(i, j)
                keep = d <= self.bound[i]
                i, j = i[keep], j[keep]
                self.found.append((i, d[keep], r0[j], r1[j], y[j]))
                pending += len(i)
                if pending > FOUND:
                    self._settle()
                    pending = 0
        self._settle()

    def _home(self, tree: Tree, chunk: _Chunk, edges: np.ndarray) -> None:
        """Bounds from the leaf in which a query row lies."""
        home = tree.home(self.points)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(tree.leaves + 1))
        for c in range(tree.leaves):
            part, wide = slice(edges[c], edges[c + 1]), edges[c + 1] - edges[c]
            if wide < self.k:
                continue
            for first in range(cuts[c], cuts[c + 1], step := max(1, CELLS // wide)):
                some = order[first:min(first + step, cuts[c + 1])]
                approx = chunk.distances(some, part)
                approx[self.own[some, None] == chunk.other[None, part]] = np.inf
                kth = np.partition(approx, self.k - 1, axis=1)[:, self.k - 1]
                self.bound[some] = np.minimum(self.bound[some], kth + chunk.margin[some])

    def _settle(self) -> None:
        """Keeps the k nearest of what was found, and tightens the bounds."""
        rows, dist, r0, r1, y = (np.concatenate(p) for p in zip(*self.found))
        order = _in_order(rows, dist, r0, r1, self.ties)
        count = np.bincount(rows, minlength=len(self.points))
        order = order[np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) < self.k]
        self.found = [tuple(v[order] for v in (rows, dist, r0, r1, y))]
        full = count >= self.k
        last = np.cumsum(np.minimum(count, self.k)) - 1
        self.bound[full] = np.minimum(self.bound[full], self.found[0][1][last[full]])

    def near(self) -> Near:
        rows, dist, r0, _, y = self.found[0]
        have = np.bincount(rows, minlength=len(self.points))
        at = np.arange(len(rows)) - np.repeat(np.cumsum(have) - have, have)
        shape = (len(self.points), self.k)
        near = Near(have, np.full(shape, np.inf), np.full(shape, -1, np.int64), np.zeros(shape))
        near.dist[rows, at], near.ids[rows, at], near.y[rows, at] = dist, r0, y
        return near

    def kth(self) -> np.ndarray:
        """k-th distance of each row, inf with fewer neighbours."""
        return np.where(np.bincount(self.found[0][0], minlength=len(self.points)) >= self.k, self.bound, np.inf)


def _nearest(n_features: int, k: int):
    """The k nearest rows of a group (``_side`` 1) for each of its query rows, within their bounds, of another ``_g`` than theirs."""
    feats = [f"_f{j}" for j in range(n_features)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        block = _Block(q[feats].to_numpy("float64"), q["_g"].to_numpy("int64"), q["_bound"].to_numpy("float64"), k)
        if len(q) and len(r):
            block.see(r[feats].to_numpy("float64"), *(r[c].to_numpy(t) for c, t in (("_g", "int64"), ("_r0", "int64"), ("_r1", "int64"), ("_y", "float64"))))
        rows, dist, r0, r1, y = block.found[0]
        return pd.DataFrame({"_q": q["_q"].to_numpy("int64")[rows], "_r0": r0, "_r1": r1, "_dist": dist, "_y": y})
    return run


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` or a little more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _by_block(batches: Iterator[pa.RecordBatch], names: Sequence[str], k: int, chunk_rows: int, far: np.ndarray, ties: bool) -> Iterator[tuple[pa.Table, _Block]]:
    """(query rows, their block) of a stream sorted by (``_b``, ``_side``): query rows first, then reference rows."""
    current, asked, held, block = None, [], [], None

    def column(table, name):
        return table.column(name).to_numpy()

    def points(table) -> np.ndarray:
        return np.column_stack([column(table, c) for c in names])

    def begin() -> _Block | None:
        if not asked:
            return None
        table = pa.Table.from_batches(asked)
        return _Block(points(table), column(table, "_g"), far[column(table, "_cell")], k, ties)

    def see() -> None:
        table = pa.Table.from_batches(held)
        held.clear()
        if block is not None:
            block.see(points(table), *(column(table, c) for c in ("_g", "_r0", "_r1", "_y")))

    for batch in batches:
        number, is_ref = batch.column("_b").to_numpy(), batch.column("_side").to_numpy() > 0
        edges = np.flatnonzero((np.diff(number) != 0) | np.diff(is_ref)) + 1
        for first, last in zip([0, *edges], [*edges, len(batch)]):
            if first == last:
                continue
            if number[first] != current:
                if current is not None:
                    block = block or begin()
                    if held:
                        see()
                    if asked:
                        yield pa.Table.from_batches(asked), block
                current, asked, held, block = number[first], [], [], None
            part = batch.slice(first, last - first)
            if not is_ref[first]:
                asked.append(part)
                continue
            block = block or begin()
            held.append(part)
            if sum(map(len, held)) >= chunk_rows:
                see()
    if current is not None:
        block = block or begin()
        if held:
            see()
        if asked:
            yield pa.Table.from_batches(asked), block


def _best(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("_q").orderBy("_dist", "_r0", "_r1")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def usable(features: Sequence[str]) -> Column:
    """Whether a row has all of the features."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features])


# --------------------------------------------------------------------------- the search

Finish = Callable[[Near, pa.Table], list]


def search(queries: DataFrame, reference: DataFrame, features: Sequence[str], k: int, keep: Sequence[str], ref_ids: Sequence[str],
           label: str, finish: Finish, fields: Sequence[T.StructField], group: str | None = None, cell_rows: int = CELL_ROWS,
           block_rows: int = BLOCK_ROWS, ref_block_rows: int = REF_BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per query row: its ``keep`` columns and ``fields``, the arrays that ``finish`` makes of its k nearest rows and its
    kept columns (``_k0``, ...); NULL for a query row without all features.

    With ``group`` (an integer column of both sides) rows of a query row's own group are not its neighbours."""
    spark = queries.sparkSession
    feats = [F.col(c).cast("double").alias(f"_f{j}") for j, c in enumerate(features)]
    names = [f"_f{j}" for j in range(len(features))]
    own = F.col(group).cast("bigint") if group else F.lit(0).cast("bigint")
    other = F.col(group).cast("bigint") if group else F.lit(1).cast("bigint")
    r1 = F.coalesce(F.col(ref_ids[1]).cast("bigint"), F.lit(-1)) if len(ref_ids) > 1 else F.lit(0).cast("bigint")
    refs = reference.where(usable(features) & F.col(label).isNotNull()).select(
        F.coalesce(F.col(ref_ids[0]).cast("bigint"), F.lit(NO_ID)).alias("_r0"), r1.cast("bigint").alias("_r1"), F.col(label).cast("double").alias("_y"),
        F.coalesce(other, F.lit(-1)).alias("_g"), *feats)
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    asked = queries.where(usable(features)).select(F.coalesce(own, F.lit(-2)).alias("_g"), F.pmod(F.xxhash64(*keep), F.lit(1 << 20)).cast("int").alias("_h"), *feats, *kept)

    total = refs.count()
    share = min(1.0, sample_rows / max(total, 1))
    drawn = refs if share == 1.0 else refs.where(F.pmod(F.xxhash64("_r0", "_r1", *names), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = np.column_stack([c.to_numpy() for c in drawn.select(*names).limit(2 * sample_rows).toArrow().columns]) if total > cell_rows \
        else np.zeros((0, len(names)))
    tree = Tree(sample, max(2 * k, int(cell_rows * len(sample) / max(total, 1))), k)
    shared = spark.sparkContext.broadcast(tree)

    def dealt(frame: DataFrame, extra: Sequence[T.StructField], place) -> DataFrame:
        """``frame`` with the columns ``extra``: a row as often as ``place(points, batch)`` says, (row numbers, columns)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = LEAST_WALK
            for batch in _gathered(batches, MOST_WALK):
                start = 0
                while start < len(batch):
                    part = batch.slice(start, step)
                    rows, columns = place(np.column_stack([part.column(c).to_numpy() for c in names]), part)
                    for first in range(0, len(rows), 1 << 16):
                        some = slice(first, first + (1 << 16))
                        yield pa.RecordBatch.from_arrays([*part.take(pa.array(rows[some])).columns, *(pa.array(c[some]) for c in columns)],
                                                         names=[*part.schema.names, *(f.name for f in extra)])
                    # many rows share the walk through the tree, unless each of them goes to many blocks
                    start, step = start + step, int(min(MOST_WALK, max(LEAST_WALK, FOUND * len(part) / max(len(rows), 1))))
        return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *extra]))

    def int_field(name: str) -> T.StructField:
        return T.StructField(name, T.IntegerType())

    cells = dealt(asked.select(*names), [int_field("_cell")], lambda points, _: (np.arange(len(points)), [shared.value.home(points).astype(np.int32)]))
    rows = np.zeros(tree.leaves, np.int64)
    for c, n in cells.groupBy("_cell").count().collect():
        rows[c] = n
    # blocks of neighbouring cells (their numbers follow the tree); a cell with many query rows has several
    most = max(1, min(block_rows, NEIGHBOURS // k, max(256, int(rows.sum()) // (2 * spark.sparkContext.defaultParallelism))))
    first, many, block, filled = np.zeros(tree.leaves, np.int64), np.maximum(1, -(-rows // most)), 0, 0
    for c in range(tree.leaves):
        if filled and filled + rows[c] > most:
            block, filled = block + 1, 0
        first[c], filled = block, filled + rows[c]
        if many[c] > 1:
            block, filled = block + int(many[c]), 0
    blocks = int((first + many).max())
    where = spark.sparkContext.broadcast((first, many))

    def ask(points, batch):
        cell, (first, many) = shared.value.home(points), where.value
        return np.arange(len(points)), [(first[cell] + batch.column("_h").to_numpy() % many[cell]).astype(np.int32), np.zeros(len(points), np.int32), cell.astype(np.int32)]

    def expand(rows: np.ndarray, cell: np.ndarray, home: np.ndarray):
        """Row numbers, blocks and sides (1 in a block of the own cell, else 2), a row once for each block of the cells."""
        first, many = where.value
        n = many[cell]
        block = np.repeat(first[cell] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs = np.unique(np.repeat(rows, n) * blocks + block)
        rows, block = pairs // blocks, pairs % blocks
        at_home = (block >= first[home[rows]]) & (block < first[home[rows]] + many[home[rows]])
        return rows, [block.astype(np.int32), np.where(at_home, 1, 2).astype(np.int32)]

    def at_home(points, _):
        cell = shared.value.home(points)
        return expand(np.arange(len(points)), cell, cell)

    placed = [int_field("_b"), int_field("_side")]
    sent = dealt(asked, [*placed, int_field("_cell")], ask).drop("_h")

    def stream(held: DataFrame, far: np.ndarray, out, schema: T.StructType, questions: DataFrame, ties: bool = True) -> DataFrame:
        """Rows that ``out`` makes of each block."""
        both = questions.unionByName(held, allowMissingColumns=True).repartitionById(blocks, F.col("_b")).sortWithinPartitions("_b", "_side")
        far = spark.sparkContext.broadcast(far)
        order = ["_b", "_side", "_cell", "_g", "_r0", "_r1", "_y", *names]
        both = both.select(*order, *[c for c in both.columns if c not in order])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, block in _by_block(batches, names, k, ref_block_rows, far.value, ties):
                yield pa.RecordBatch.from_arrays(out(table, block), names=schema.names)
        return both.mapInArrow(run, schema)

    far = np.full(tree.leaves, np.inf)
    low, high = np.full((tree.leaves, len(names)), -np.inf), np.full((tree.leaves, len(names)), np.inf)
    if tree.leaves > 1:
        def walls(table: pa.Table, block: _Block):
            cell, kth = table.column("_cell").to_numpy(), block.kth()
            order = np.argsort(cell, kind="stable")
            own, at = np.unique(cell[order], return_index=True)
            ends = [g.reduceat(block.points[order], at) for g in (np.minimum, np.maximum)]
            return [pa.array(own, pa.int32()), pa.array(np.maximum.reduceat(kth[order], at)), *(pa.array(list(e), pa.list_(pa.float64())) for e in ends)]

        doubles = T.ArrayType(T.DoubleType())
        schema = T.StructType([int_field("_cell"), T.StructField("far", T.DoubleType()), T.StructField("low", doubles), T.StructField("high", doubles)])
        far, low, high = np.full(tree.leaves, -np.inf), -low, -high
        narrow = sent.select("_b", "_side", "_cell", "_g", *names)
        for r in stream(dealt(refs, placed, at_home), np.full(tree.leaves, np.inf), walls, schema, narrow, ties=False).collect():  # a row per cell and block of it
            c = r["_cell"]
            far[c], low[c], high[c] = max(far[c], r["far"]), np.minimum(low[c], r["low"]), np.maximum(high[c], r["high"])
    reached = spark.sparkContext.broadcast((tree.upwards(far), *tree.boxes(low, high)))

    def wanted(points, _):
        rows, cell = shared.value.reach(points, *reached.value)
        return expand(rows, cell, shared.value.home(points))

    def finished(table: pa.Table, block: _Block):
        kept = [table.column(f"_k{i}").combine_chunks() for i in range(len(keep))]
        return [*kept, *finish(block.near(), table)]

    schema = T.StructType([*[T.StructField(f"_k{i}", queries.schema[c].dataType) for i, c in enumerate(keep)], *fields])
    answers = stream(dealt(refs, placed, wanted), far, finished, schema, sent)
    silent = queries.where(~usable(features)).select(*kept, *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    return answers.unionByName(silent).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[f.name for f in fields])


def knn_neighbours(queries: DataFrame, reference: DataFrame, features: Sequence[str], k: int, query_id: str,
                   ref_ids: Sequence[str], label: str, group: str | None = None, **kw) -> DataFrame:
    """(query_id, neighbour rank 1..k, dist, label, ref_id) of the k nearest reference rows."""
    def lists(near: Near, _):
        offsets = pa.array(np.concatenate([[0], np.cumsum(near.have)]), pa.int32())
        there = np.arange(near.dist.shape[1]) < near.have[:, None]
        place = np.broadcast_to(np.arange(near.dist.shape[1]), there.shape)
        parts = (pa.array(place[there], pa.int64()), pa.array(near.dist[there]), pa.array(near.y[there]), pa.array(near.ids[there]))
        return [pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names=["_r1", "_dist", "_y", "_r0"]))]

    row = T.StructType([T.StructField("_r1", T.LongType()), T.StructField("_dist", T.DoubleType()), T.StructField("_y", T.DoubleType()), T.StructField("_r0", T.LongType())])
    keyed = queries.withColumn("_q", F.monotonically_increasing_id())
    near = search(keyed, reference, features, k, ["_q", query_id], ref_ids, label, lists, [T.StructField("near", T.ArrayType(row))], group, **kw)
    found = near.select("_q", query_id, F.explode("near").alias("n")).select("_q", query_id, "n.*")
    return _best(found, k).select(query_id, "rank", F.col("_dist").alias("dist"), F.col("_y").alias(label), F.nullif("_r0", F.lit(NO_ID)).alias("ref_id"))


def _means(ks: Sequence[int]) -> Finish:
    """Mean label of the first k neighbours for every k, NULL without any."""
    def finish(near: Near, _) -> list:
        sums = np.cumsum(near.y, axis=1)
        out = []
        for k in ks:
            n = np.minimum(near.have, k)
            out.append(pa.array(sums[np.arange(len(n)), np.maximum(n - 1, 0)] / np.maximum(n, 1), mask=n == 0))
        return out
    return finish


def _averaged(queries, reference, features, k, query_id, ref_ids, label, **kw) -> DataFrame:
    """(query_id, value): mean label of the k neighbours, NULL for a query row without all features."""
    return search(queries, reference, features, k, [query_id], ref_ids, label, _means([k]), [T.StructField("value", T.DoubleType())], **kw)


def knn_regress(queries: DataFrame, reference: DataFrame, features, k: int, query_id: str, ref_ids, label: str,
                **kw) -> DataFrame:
    """Mean label of the neighbours; a query row that lacks a feature keeps its row, with a NULL prediction."""
    return _averaged(queries, reference, features, k, query_id, ref_ids, label, **kw).withColumnRenamed("value", "prediction")


def knn_classify(queries: DataFrame, reference: DataFrame, features, k: int, query_id: str, ref_ids, label: str,
                 **kw) -> DataFrame:
    """Binary majority vote; probability = share of votes for class 1; a tied vote goes to 0; NULL without all features."""
    g = _averaged(queries, reference, features, k, query_id, ref_ids, label, **kw).withColumnRenamed("value", "probability")
    return g.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def knn_cv_predictions(train: DataFrame, features, label: str, id_cols: Sequence[str], ks: Sequence[int], fold_col: str, **kw) -> DataFrame:
    """(ids, fold, label, p<k> per k): each row's mean neighbour label among the rows of the other folds.

    All folds and all k share one search: neighbours of a row's own fold are passed over, the largest k is searched
    and smaller k take the first of its ranked neighbours."""
    keyed = train.withColumn("_id", F.struct(*id_cols))
    rows = search(keyed, train, features, max(ks), ["_id"], id_cols, label, _means(ks), [T.StructField(f"p{k}", T.DoubleType()) for k in ks], fold_col, **kw)
    return rows.join(keyed.select("_id", fold_col, label), "_id").select("_id.*", fold_col, label, *[f"p{k}" for k in ks])


def knn_cv_grid(train: DataFrame, features, label: str, id_col: str, ks, fold_col: str = "fold") -> DataFrame:
    """(params, cv_metric): mean over the folds of R^2 of kNN regression for every k (scikit-learn's default score)."""
    j = knn_cv_predictions(train, features, label, [id_col], ks, fold_col)
    sst = F.var_pop(label) * F.count(F.lit(1))  # total sum of squares
    per_fold = j.groupBy(fold_col).agg(*[(1 - F.sum(F.pow(F.col(label) - F.col(f"p{k}"), 2)) / sst).alias(f"r2_{k}") for k in ks])
    means = per_fold.agg(*[F.avg(f"r2_{k}").alias(f"r2_{k}") for k in ks])
    return means.select(F.explode(F.array(*[F.struct(F.lit(f"n_neighbors={k}").alias("params"), F.col(f"r2_{k}").alias("cv_metric"))
                                            for k in ks])).alias("s")).select("s.*")

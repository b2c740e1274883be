"""Boosted regression trees over many rows (numpy sums in Spark tasks).

The model is that of Spark ML's ``GBTRegressor`` with squared error: the first tree counts in full, each later one is fitted to
``2 * (label - prediction)`` and counts ``step`` times; splits are chosen by variance among at most 255 cut points an input.

Every row is reduced to one byte an input once. Rows stay partitioned on the cluster as blocks of such bytes with their
residuals; each level of a tree is one pass in which the tasks add up counts and residuals per node, input and bin. Spark
adds the tasks' sums, and the driver, which sees sums alone, picks the splits.

Most rows are read by few additions: of two children only the smaller is counted (the other is the difference), rows that
stand together and agree in the inputs that seldom change (those of a zone and day) are first added up, and of an
input with one very frequent bin (silent hours) only the others are. None of this leaves out a row or changes a sum.

Rows that stand together and differ in one input alone (the silent hours of a zone and day) are held as one line of a grid,
a count and a sum of residuals for each bin of that input. A node of a tree is a set of lines times a set of bins there, so
its sums are those of a few matrix products; only the other rows are looked at one by one.
"""

from __future__ import annotations

import os
import pickle
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from demandspark.session import shared_dir

MAX_BINS = 256
BLOCK_ROWS = 1 << 17
ROUNDS_KEPT = 1  # residuals are written again after so many rounds; in between each pass makes them from the last trees
ROUNDS_A_CHAIN = 42 * ROUNDS_KEPT  # then they are made anew from all trees, so that a lost block is not remade over all rounds
SELDOM, FREQUENT = 1 / 12, 0.6
MAX_ACROSS = 32  # bins of the input along a grid's lines
TASKS_ADDED_AT_ONCE = 32  # up to so many tasks the driver adds their sums itself; more are added up by Spark first

Rows = tuple[np.ndarray, np.ndarray]  # bins (inputs x rows, bytes), residuals


@dataclass
class Tree:
    """A complete tree: a row goes right where its bin is over the node's; a node that is not split sends all rows left."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @property
    def depth(self) -> int:
        return len(self.value).bit_length() - 1

    def route(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Number of each row's node among those of a level."""
        node = np.zeros(bins.shape[1], np.uint8)
        for level in range(levels):
            right = np.zeros(bins.shape[1], bool)
            for n in range(1 << level):
                at = (1 << level) - 1 + n
                if self.bin[at] < MAX_BINS - 1:
                    right |= (node == n) & (bins[self.feature[at]] > self.bin[at])
            node = 2 * node + right
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.route(bins, self.depth)]


def unsplit(depth: int) -> Tree:
    return Tree(np.zeros(2**depth - 1, np.uint8), np.full(2**depth - 1, MAX_BINS - 1, np.uint8), np.zeros(2**depth))


# ---------------------------------------------------------------- bins


def cut_points(rows: DataFrame, inputs: Sequence[str]) -> list[np.ndarray]:
    """Per input the midpoints between its values, or, of more than 256 values, zero and quantiles of the others."""
    about = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in inputs]).first()
    few = [c for c in inputs if about[c] <= 2 * MAX_BINS]
    many = [c for c in inputs if about[c] > MAX_BINS // 2]
    shares = [i / (MAX_BINS - 1) for i in range(1, MAX_BINS - 1)]
    found = rows.agg(
        F.lit(0).alias("_"),
        *[F.collect_set(c).alias(f"values_{c}") for c in few],
        *[F.percentile_approx(F.when(F.col(c) != 0, F.col(c)), shares).alias(f"quantiles_{c}") for c in many],
    ).first()
    cuts = []
    for c in inputs:
        values = np.unique(np.array(found[f"values_{c}"], float)) if c in few else None
        if values is not None and len(values) <= MAX_BINS:
            cuts.append((values[1:] + values[:-1]) / 2)
        else:
            cuts.append(np.unique(np.array([0.0, *found[f"quantiles_{c}"]])))
    return cuts


def _binned(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    return np.array([np.searchsorted(cut, values) for values, cut in zip(columns, cuts, strict=True)], np.uint8)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [column.to_numpy(zero_copy_only=False) for column in batch.columns]


def _to_blocks(cuts: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def block(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bins, labels = (np.concatenate(side, axis=-1) for side in zip(*parts, strict=True))
        return pa.RecordBatch.from_pydict({"bins": [bins.tobytes()], "labels": [labels.astype(float).tobytes()]})

    parts, rows = [], 0
    for batch in batches:
        *inputs, label = _columns(batch)
        parts.append((_binned(inputs, cuts), label))
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield block(parts)
            parts, rows = [], 0
    if rows:
        yield block(parts)


def _from_row(row) -> Rows:
    labels = np.frombuffer(row["labels"])
    return np.frombuffer(row["bins"], np.uint8).reshape(-1, len(labels)), labels


# ---------------------------------------------------------------- sums


@dataclass
class Layout:
    """What is known of all rows: the bin of each input that most rows have (-1: none), and the inputs that seldom change."""

    frequent: list[int]
    steady: list[int]
    across: int = -1  # the input along the lines of a grid (-1: none)
    columns: tuple[int, ...] = ()  # its bins


def _profile(blocks: Iterator[Rows]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows per input and bin, and how often each input changes from one row to the next."""
    counts = changes = 0
    for bins, _ in blocks:
        counts = counts + np.array([np.bincount(values, minlength=MAX_BINS) for values in bins])
        changes = changes + np.count_nonzero(bins[:, 1:] != bins[:, :-1], axis=1)
    if np.ndim(counts):
        yield counts, changes


def _layout(base: RDD) -> Layout:
    counts, changes = base.mapPartitions(_profile).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    rows = counts[0].sum()
    frequent = [int(c.argmax()) if c.max() > FREQUENT * rows else -1 for c in counts]
    steady = [i for i, n in enumerate(changes) if n < SELDOM * rows]
    return Layout(frequent, steady, *_across(counts, frequent, steady))


def _across(counts: np.ndarray, frequent: list[int], steady: list[int]) -> tuple[int, tuple[int, ...]]:
    """The one input, with its bins, that has few bins and neither seldom changes nor has a frequent one; none if there are several others."""
    moving = [f for f, bin in enumerate(frequent) if bin < 0 and f not in steady]
    if len(moving) != 1 or not steady:
        return -1, ()
    columns = np.flatnonzero(counts[moving[0]])
    return (moving[0], tuple(columns.tolist())) if len(columns) <= MAX_ACROSS else (-1, ())


@dataclass
class Grid:
    """Rows whose inputs are those of their line, but for the one input across, and the frequent bins elsewhere."""

    bins: np.ndarray  # steady inputs x lines
    counts: np.ndarray  # lines x columns, bytes
    sums: np.ndarray  # residuals, lines x columns

    def nodes(self, tree: Tree, levels: int, layout: Layout) -> list[tuple[np.ndarray, np.ndarray]]:
        """Lines and columns of each node of a level. A node beyond a split at another input may have rows of its lines, but none of its columns."""
        found = [(np.ones(self.bins.shape[1], bool), np.ones(len(layout.columns), bool))]
        for level in range(levels):
            below = []
            for at, (lines, columns) in enumerate(found, (1 << level) - 1):
                feature, cut = tree.feature[at], tree.bin[at]
                if cut == MAX_BINS - 1:
                    below += [(lines, columns), (np.zeros_like(lines), columns)]
                elif feature in layout.steady:
                    over = self.bins[layout.steady.index(feature)] > cut
                    below += [(lines & ~over, columns), (lines & over, columns)]
                else:
                    over = np.array(layout.columns if feature == layout.across else [layout.frequent[feature]]) > cut
                    below += [(lines, columns & ~over), (lines, columns & over)]
            found = below
        return found

    def predict(self, trees: Sequence[Tree], layout: Layout) -> np.ndarray:
        """Sum of the trees' values for a row of each line and column."""
        total = np.zeros((self.bins.shape[1], len(layout.columns)))
        for tree in trees:
            leaves = [(*node, value) for node, value in zip(self.nodes(tree, tree.depth, layout), tree.value, strict=True) if node[1].any()]
            total += np.array([lines for lines, _, _ in leaves], float).T @ np.array([columns * value for _, columns, value in leaves])
        return total


@dataclass
class Block:
    """Rows in a grid, if there is one, and rows one by one with the grid's line that each stands in."""

    grid: Grid | None
    rows: Rows
    line: np.ndarray | None = None


def _places(bins: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows belong into a grid; the line of every row; the column of each row of the grid; the first row of each line."""
    changed = reduce(np.logical_or, [bins[f, 1:] != bins[f, :-1] for f in layout.steady])
    start = np.concatenate([[0], np.flatnonzero(changed) + 1])
    long = np.diff(start, append=bins.shape[1]).max() >= MAX_BINS
    if long:  # so that counts stay bytes
        changed = changed | (np.arange(1, bins.shape[1]) % (MAX_BINS - 1) == 0)
        start = np.concatenate([[0], np.flatnonzero(changed) + 1])
    line = np.concatenate([[0], np.cumsum(changed)])
    plain = np.ones(bins.shape[1], bool)
    for f, frequent in enumerate(layout.frequent):
        if f not in layout.steady and f != layout.across:
            plain &= bins[f] == frequent
    column = np.searchsorted(np.array(layout.columns), bins[layout.across][plain])
    return plain, line, column, start


def packed(layout: Layout, rows: Rows) -> Block:
    """The same rows, those that fit in a grid."""
    bins, residuals = rows
    if layout.across < 0:
        return Block(None, rows)
    plain, line, column, start = _places(bins, layout)
    shape = (len(start), len(layout.columns))
    key = line[plain] * shape[1] + column
    counts = np.bincount(key, None, shape[0] * shape[1]).reshape(shape).astype(np.uint8)
    sums = np.bincount(key, residuals[plain], shape[0] * shape[1]).reshape(shape)
    rest = ~plain
    return Block(Grid(bins[layout.steady][:, start], counts, sums), (bins[:, rest], residuals[rest]), line[rest].astype(np.int32))


def _add(sums: np.ndarray, key: np.ndarray, values: np.ndarray, counts: np.ndarray | None = None) -> None:
    """Count of rows and sum of values per key, added to ``sums`` (2 x slots x bins)."""
    for side, weights in zip(sums, (counts, values), strict=True):
        side += np.bincount(key, weights, side.size).reshape(side.shape)


def block_sums(bins: np.ndarray, residuals: np.ndarray, tree: Tree, level: int, slots: np.ndarray, layout: Layout) -> np.ndarray:
    """Rows and residuals of a block: 2 x inputs x slots x bins, of those rows whose node has a slot (others: -1)."""
    size = slots.max() + 1
    sums = np.zeros((2, len(bins), size, MAX_BINS))
    at, slot = slice(None), np.zeros(bins.shape[1], np.intp)
    if level:
        slot = slots[tree.route(bins, level)]
        at = np.flatnonzero(slot >= 0)
        slot, residuals = slot[at], residuals[at]
    if not len(slot):
        return sums
    if layout.steady:
        changed = reduce(np.logical_or, [bins[f, 1:] != bins[f, :-1] for f in layout.steady])
        run = np.concatenate([[0], np.cumsum(changed, dtype=np.int32)])[at] * size + slot
        start = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1])
        lengths, totals = np.diff(start, append=len(run)), np.add.reduceat(residuals, start)
        first, node = (start if isinstance(at, slice) else at[start]), slot[start] * MAX_BINS
        for f in layout.steady:
            _add(sums[:, f], node + bins[f][first], totals, lengths)
    whole = np.array([np.bincount(slot, None, size), np.bincount(slot, residuals, size)])
    node = slot * MAX_BINS
    for f, frequent in enumerate(layout.frequent):
        if f in layout.steady:
            continue
        values = bins[f][at]
        if frequent < 0:
            _add(sums[:, f], node + values, residuals)
        else:
            rest = np.flatnonzero(values != frequent)
            _add(sums[:, f], node[rest] + values[rest], residuals[rest])
            sums[:, f, :, frequent] = whole - sums[:, f].sum(axis=-1)
    return sums


def grid_sums(block: Block, tree: Tree, level: int, slots: np.ndarray, layout: Layout) -> np.ndarray:
    """What :func:`block_sums` makes of the same rows: steady inputs are summed by line, the frequent bins follow from the whole."""
    grid, (bins, residuals), line, size = block.grid, block.rows, block.line, slots.max() + 1
    sums = np.zeros((2, len(bins), size, MAX_BINS))
    slot = np.zeros(len(residuals), np.intp)
    if level:
        slot = slots[tree.route(bins, level)]
        at = np.flatnonzero(slot >= 0)
        bins, residuals, line, slot = bins[:, at], residuals[at], line[at], slot[at]
    moving = [f for f in range(len(bins)) if f not in layout.steady]
    for f in moving:
        _add(sums[:, f], slot * MAX_BINS + bins[f], residuals)
    along = np.zeros((2, size, len(grid.sums)))
    _add(along, slot * len(grid.sums) + line, residuals)
    nodes = grid.nodes(tree, level, layout)
    wanted = sorted((slot, node) for node, slot in enumerate(slots) if slot >= 0)
    lines, columns = (np.array([nodes[node][i] for _, node in wanted]) for i in (0, 1))
    for side, table in enumerate((grid.counts.astype(float), grid.sums)):
        along[side] += columns.astype(float) @ table.T
        across = (lines.astype(float) @ table) * columns
        sums[side, layout.across][:, list(layout.columns)] += across
        for f in moving:
            if f != layout.across:
                sums[side, f, :, layout.frequent[f]] += across.sum(axis=1)
    for slot, within in enumerate(lines):
        at = np.flatnonzero(within)
        for f, steady in zip(layout.steady, grid.bins, strict=True):
            for side in (0, 1):
                sums[side, f, slot] = np.bincount(steady[at], along[side, slot, at], MAX_BINS)
    return sums


def _less(trees: Sequence[Tree], rows: Rows) -> Rows:
    bins, residuals = rows
    for tree in trees:
        residuals = residuals - tree.predict(bins)
    return bins, residuals


def _advance(trees: list[Tree], layout: Layout, block: Block) -> Block:
    grid = block.grid
    if grid is not None and trees:
        grid = Grid(grid.bins, grid.counts, grid.sums - grid.counts * grid.predict(trees, layout))
    return Block(grid, _less(trees, block.rows), block.line)


def predictions(bins: np.ndarray, trees: Sequence[Tree], layout: Layout) -> np.ndarray:
    """Sum of the trees' values for every row."""
    if layout.across < 0 or not bins.shape[1]:
        return -_less(trees, (bins, np.zeros(bins.shape[1])))[1]
    plain, line, column, start = _places(bins, layout)
    known = np.isin(bins[layout.across][plain], layout.columns)
    plain[plain] = known
    total = np.empty(bins.shape[1])
    lines = Grid(bins[layout.steady][:, start], np.empty(0), np.empty(0)).predict(trees, layout)
    total[plain] = lines[line[plain], column[known]]
    total[~plain] = -_less(trees, (bins[:, ~plain], np.zeros(len(plain) - plain.sum())))[1]
    return total


def _sums(block: Block, tree: Tree, level: int, slots: np.ndarray, layout: Layout) -> np.ndarray:
    if block.grid is None:
        return block_sums(*block.rows, tree, level, slots, layout)
    return grid_sums(block, tree, level, slots, layout)


def _task_sums(
    ahead: list[Tree], tree: Tree, level: int, slots: np.ndarray, layout: Layout, blocks: Iterator[Block]
) -> Iterator[np.ndarray]:
    total = None
    for block in blocks:
        sums = _sums(_advance(ahead, layout, block), tree, level, slots, layout)
        total = sums if total is None else total + sums
    if total is not None:
        yield total


def _added(made: RDD) -> np.ndarray:
    return made.treeReduce(np.add) if made.getNumPartitions() > TASKS_ADDED_AT_ONCE else reduce(np.add, made.collect())


# ---------------------------------------------------------------- where residuals are kept


class Cached:
    """Blocks cached by Spark; their residuals are written again after every few trees."""

    def __init__(self, base: RDD, layout: Layout):
        self.base, self.layout, self.trees, self.ahead, self.old = base, layout, [], [], None
        self.state = base.persist(StorageLevel.MEMORY_AND_DISK)

    def sums(self, tree: Tree, level: int, slots: np.ndarray) -> np.ndarray:
        return _added(self.state.mapPartitions(partial(_task_sums, self.ahead, tree, level, slots, self.layout)))

    def grown(self, tree: Tree) -> None:
        """From now on residuals are what ``tree`` leaves of them."""
        if self.old is not None:
            self.old.unpersist()
            self.old = None
        self.trees, self.ahead = [*self.trees, tree], [*self.ahead, tree]
        if len(self.ahead) == ROUNDS_KEPT:
            source, since = (self.state, self.ahead) if len(self.trees) % ROUNDS_A_CHAIN else (self.base, self.trees)
            self.old = self.state
            self.state = source.map(partial(_advance, since, self.layout)).persist(StorageLevel.MEMORY_AND_DISK)
            self.ahead = []

    def close(self) -> None:
        for cached in (self.base, self.old, self.state):
            if cached is not None:
                cached.unpersist()


def shared_files(spark: SparkSession) -> str | None:
    """The shared folder as a path that can be opened, if it is one: a task then reads its blocks from there without the JVM between."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return None
    return urlparse(path.toUri().toString()).path


def _write(path: str, items: Iterator) -> Iterator:
    """Pass the items on while they are written; the file is there once all are, however often a task is run."""
    begun = f"{path}-{uuid.uuid4().hex}"
    with open(begun, "wb") as out:
        for item, kept in items:
            pickle.dump(kept, out, 5)
            yield item
    os.replace(begun, path)


def _read(path: str) -> Iterator:
    with open(path, "rb") as source:
        while source.peek(1):
            yield pickle.load(source)


def _residuals(block: Block) -> tuple[np.ndarray | None, np.ndarray]:
    return None if block.grid is None else block.grid.sums, block.rows[1]


def _rest(block: Block) -> tuple:
    return block.grid and (block.grid.bins, block.grid.counts), block.rows[0], block.line


def _store(folder: str, index: int, blocks: Iterator[Block]) -> Iterator[int]:
    kept = _write(f"{folder}/{index}", ((block, _rest(block)) for block in blocks))
    yield sum(1 for _ in _write(f"{folder}/{index}-0", ((block, _residuals(block)) for block in kept)))


def _stored(folder: str, index: int, number: int) -> Iterator[Block]:
    for (grid, bins, line), (sums, residuals) in zip(_read(f"{folder}/{index}"), _read(f"{folder}/{index}-{number}"), strict=True):
        yield Block(grid and Grid(*grid, sums), (bins, residuals), line)


def _stored_sums(
    folder: str, number: int, last: Tree | None, tree: Tree, level: int, slots: np.ndarray, layout: Layout, indices: Iterator[int]
) -> Iterator[np.ndarray]:
    """Sums over stored blocks; with ``last``, over what it leaves of the residuals, which is stored under the next number."""
    for index in indices:
        blocks = _stored(folder, index, number)
        if last is not None:
            less = (_advance([last], layout, block) for block in blocks)
            blocks = _write(f"{folder}/{index}-{number + 1}", ((block, _residuals(block)) for block in less))
        yield from _task_sums([], tree, level, slots, layout, blocks)


class Stored:
    """Blocks in files of the shared folder: what never changes once, residuals anew for every tree."""

    def __init__(self, base: RDD, layout: Layout, shared: str):
        self.layout, self.number, self.last = layout, 0, None
        self.folder = f"{shared}/residuals-{uuid.uuid4().hex}"
        os.makedirs(self.folder)
        base.mapPartitionsWithIndex(partial(_store, self.folder)).count()
        tasks = base.getNumPartitions()
        self.tasks = base.context.parallelize(range(tasks), tasks)

    def sums(self, tree: Tree, level: int, slots: np.ndarray) -> np.ndarray:
        task = partial(_stored_sums, self.folder, self.number, self.last, tree, level, slots, self.layout)
        added = _added(self.tasks.mapPartitions(task))
        if self.last is not None:
            self._remove(f"-{self.number}")
            self.number, self.last = self.number + 1, None
        return added

    def grown(self, tree: Tree) -> None:
        """From now on residuals are what ``tree`` leaves of them."""
        self.last = tree

    def _remove(self, ending: str) -> None:
        for name in os.listdir(self.folder):
            if name.endswith(ending):
                os.remove(f"{self.folder}/{name}")

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


# ---------------------------------------------------------------- trees


def best_split(sums: np.ndarray) -> tuple[int, int, bool] | None:
    """(input, bin, whether the left side is the smaller) of the split that lowers the variance most, if one does.

    ``sums`` holds rows and residuals per input and bin; ties go to the first input and the lowest bin.
    """
    n, s = sums[:, 0].sum(axis=-1)
    left_n, left_s = np.cumsum(sums, axis=-1)
    right_n, right_s = n - left_n, s - left_s
    real = (left_n > 0) & (right_n > 0) & (sums[0] > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(real, left_s**2 / left_n + right_s**2 / right_n - s**2 / n, 0)
    feature, cut = divmod(int(gain.argmax()), gain.shape[1])
    return (feature, cut, bool(left_n[feature, cut] <= right_n[feature, cut])) if gain[feature, cut] > 0 else None


def grow(kept: Cached | Stored, depth: int) -> Tree:
    """One tree on the rows' residuals; one pass over the rows for each level."""
    tree = unsplit(depth)
    nodes: dict[int, np.ndarray] = {}
    slots = np.zeros(1, np.intp)
    pairs: list[tuple[int, int]] = []  # (child that is counted, its sibling) by slot
    for level in range(depth):
        counted = kept.sums(tree, level, slots)
        parents, nodes = nodes, {}
        if not level:
            nodes[0] = counted[:, :, 0]
        for slot, (child, sibling) in enumerate(pairs):
            nodes[child] = counted[:, :, slot]
            nodes[sibling] = parents[child // 2] - counted[:, :, slot]
        last, pairs = level == depth - 1, []
        for n, sums in nodes.items():
            split, spread = best_split(sums), 1 << (depth - level)
            count, total = sums[:, 0].sum(axis=-1)
            tree.value[n * spread : (n + 1) * spread] = total / count
            if split is None:
                continue
            feature, cut, small_left = split
            tree.feature[(1 << level) - 1 + n], tree.bin[(1 << level) - 1 + n] = feature, cut
            pairs.append((2 * n + (not small_left), 2 * n + small_left))
            if last:
                left = sums[:, feature, : cut + 1].sum(axis=-1)
                right = sums[:, feature, cut + 1 :].sum(axis=-1)
                tree.value[2 * n], tree.value[2 * n + 1] = left[1] / left[0], right[1] / right[0]
        if not pairs:
            break
        slots = np.full(2 << level, -1)
        for slot, (child, _) in enumerate(pairs):
            slots[child] = slot
    return tree


@dataclass
class BoostedTrees:
    inputs: tuple[str, ...]
    cuts: list[np.ndarray]
    trees: list[Tree]
    layout: Layout

    def predict(self, rows: DataFrame, keep: Sequence[str], name: str = "predicted") -> DataFrame:
        """The kept columns of every row with its prediction."""
        inputs, cuts, trees, layout = self.inputs, self.cuts, self.trees, self.layout

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _large(batches):
                bins = _binned(_columns(batch.select(list(range(len(keep), batch.num_columns)))), cuts)
                total = predictions(bins, trees, layout)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(total)], names=[*keep, name])

        schema = StructType([*rows.select(*keep).schema.fields, StructField(name, DoubleType())])
        return rows.select(*keep, *_as_doubles(inputs, "_input_")).mapInArrow(run, schema)


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a block's size."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def _as_doubles(inputs: Sequence[str], prefix: str = "") -> list[Column]:
    return [F.col(c).cast("double").alias(prefix + c) for c in inputs]


def fit(rows: DataFrame, inputs: Sequence[str], label: str, iterations: int, step: float, depth: int) -> BoostedTrees:
    """``iterations`` trees on every row; inputs and label hold finite numbers. Any order gives the same sums."""
    context = rows.sparkSession.sparkContext
    rows = rows.select(*_as_doubles([*inputs, label]))
    cuts = cut_points(rows, inputs)
    blocks = rows.mapInArrow(partial(_to_blocks, cuts), "bins binary, labels binary")
    whole = blocks.repartition(context.defaultParallelism).rdd.map(_from_row)
    layout = _layout(whole)
    base, shared = whole.map(partial(packed, layout)), shared_files(rows.sparkSession)
    kept = Cached(base, layout) if shared is None else Stored(base, layout, shared)
    trees: list[Tree] = []
    try:
        while len(trees) < iterations:
            tree = grow(kept, depth)
            tree.value *= 2 * step if trees else 1
            trees.append(tree)
            kept.grown(tree)
    finally:
        kept.close()
    return BoostedTrees(tuple(inputs), cuts, trees, layout)

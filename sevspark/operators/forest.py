"""Random forest on binned rows: bootstrap, a draw of columns for each node, the best cut by impurity, sisters of one class merged.

Columns are binned once (at most ``BINS`` bins each) and rows are packed into blocks in a written table. A node of up to
``LOCAL_ROWS`` rows is grown to its leaves inside one task, level by level over arrays, so a deep tree takes no job for each of
its levels. Nodes of more rows are split first: a job sums their histograms over all blocks, adds them up by node and returns the
cuts; the rows of what then is small enough are dealt by node, once. A table of up to ``LOCAL_ROWS`` rows is sent to all tasks
instead, which then grow whole trees. Trees are made in waves of bounded size.

What a row counts in a tree depends on seed, tree, block and place in the block, the columns of a node on seed, tree and path; so
both ways make the same trees, a smaller forest is the head of a larger one, and less depth or a higher least gain only cuts
branches off. The search over parameters makes use of that. Executors need this package, as for ``boosting``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .boosting import binned

BINS = 32
#: Shares of a column's rows whose limits are looked at for its bins, and the error of these: one in so many rows.
SHARES, ACCURACY = 2_000, 10_000
#: Rows of a node that one task grows to its leaves.
LOCAL_ROWS = 1 << 18
#: Rows times trees of one wave.
WAVE_ROWS = 8 << 20
#: Cells of histograms, and rows times columns, that a task holds at once.
CELLS = 1 << 20
#: Rows that meet one wave of trees after the other when a table is scored.
SCORE_ROWS = 1 << 17


@dataclass(frozen=True)
class Params:
    trees: int
    depth: int
    min_rows: int = 1
    min_gain: float = 0.0
    impurity: str = "gini"
    #: how many columns a node draws, by the names that Spark gives its choices
    draw: str = "auto"
    seed: int = 42

    def columns(self, n: int) -> int:
        kind = {"auto": "all" if self.trees == 1 else "sqrt"}.get(self.draw, self.draw)
        named = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3)}
        some = named[kind] if kind in named else int(kind) if kind.isdigit() else math.ceil(float(kind) * n)
        return max(1, min(n, some))


# ---- nodes ----------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def root_key(seed: int, number: int) -> np.ndarray:
    return _mix(_mix(np.array([seed], np.int64).view(np.uint64) + _STEP) + np.array([number + 1], np.uint64) * _STEP)


def child_keys(keys: np.ndarray) -> np.ndarray:
    """Keys of the left and right child of each node, in turn."""
    return _mix(np.repeat(keys, 2) * np.uint64(2) + np.tile(np.array([1, 2], np.uint64), len(keys)))


def drawn(keys: np.ndarray, columns: int, n: int) -> np.ndarray:
    """The ``n`` columns that each node looks at, by row, in rising order."""
    if n >= columns:
        return np.tile(np.arange(columns), (len(keys), 1))
    lots = _mix(keys[:, None] + np.arange(1, columns + 1, dtype=np.uint64) * _STEP)
    return np.sort(np.argpartition(lots, n - 1, axis=1)[:, :n], axis=1)


def impurity(stats: np.ndarray, kind: str) -> np.ndarray:
    """Impurity times weight of rows of class weights."""
    parts = [stats[..., k] for k in range(stats.shape[-1])]
    whole = sum(parts)
    safe = np.where(whole > 0, whole, 1)
    if kind == "gini":
        return whole - sum(s * s for s in parts) / safe
    if kind == "entropy":
        return -sum(s * np.log2(np.where(s > 0, s / safe, 1)) for s in parts)
    raise ValueError(f"unknown impurity {kind}")


@dataclass
class Shape:
    """What the growth of all nodes needs: classes, bins by column, weight of a row by class or None for weights by row."""

    classes: int
    bins: np.ndarray
    by_class: np.ndarray | None
    draw: int


def histograms(x, y, w, c, node: np.ndarray, columns: np.ndarray, shape: Shape) -> np.ndarray:
    """Sums by cell: counts by class, or weights by class and counts where weights go by row. Cells are the bins of each node's columns, in order."""
    starts = np.cumsum(np.concatenate(([0], shape.bins[columns].ravel())))
    at = (starts[:-1].reshape(columns.shape)[node] + x[np.arange(len(x))[:, None], columns[node]]).ravel()
    by_class, size, times = at * shape.classes + np.repeat(y, columns.shape[1]), int(starts[-1]), columns.shape[1]
    if shape.by_class is not None:
        return np.bincount(by_class, np.repeat(c, times), size * shape.classes).reshape(size, -1)
    weights = np.bincount(by_class, np.repeat(w, times), size * shape.classes).reshape(size, -1)
    return np.column_stack((weights, np.bincount(at, np.repeat(c, times), size)))


def weighed(sums: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """``(weights by class, counts)`` of sums of histograms."""
    if shape.by_class is not None:
        return sums * shape.by_class, sums.sum(axis=-1)
    return sums[..., :-1], sums[..., -1]


def best_cuts(hist: np.ndarray, total: np.ndarray, count: np.ndarray, columns: np.ndarray, shape: Shape, p: Params):
    """``(gain, column, cut, weights by class left, count left)`` of each node; a gain of 0 is no cut."""
    width = shape.bins[columns].ravel()
    starts = np.concatenate(([0], np.cumsum(width)))[:-1]
    owner = np.repeat(np.arange(columns.size), width)
    node = owner // columns.shape[1]
    sums = hist.cumsum(axis=0)
    left, left_rows = weighed(sums - (sums[starts] - hist[starts])[owner], shape)
    right, right_rows = total[node] - left, count[node] - left_rows
    allowed = (left_rows >= max(1, p.min_rows) - 0.5) & (right_rows >= max(1, p.min_rows) - 0.5)
    gain = impurity(total, p.impurity)[node] - impurity(left, p.impurity) - impurity(right, p.impurity)
    gain = np.where(allowed, gain / total.sum(axis=1)[node], -1.0)
    most = np.maximum.reduceat(gain, starts[:: columns.shape[1]])
    # of cuts that are equal but for rounding the first
    hits = np.flatnonzero(gain >= (most - 1e-9 * np.abs(most))[node])
    hit = hits[np.concatenate(([True], node[hits][1:] != node[hits][:-1]))]
    most = np.where((most > 1e-10) & (most >= p.min_gain), most, 0.0)
    return most, columns.ravel()[owner[hit]], hit - starts[owner[hit]], left[hit], left_rows[hit]


def splittable(stats: np.ndarray, count: np.ndarray, depth, p: Params) -> np.ndarray:
    pure = impurity(stats, "gini") <= 1e-12 * stats.sum(axis=1)
    return ~pure & (count >= 2 * max(1, p.min_rows) - 0.5) & (depth < p.depth)


@dataclass
class Tree:
    """Nodes in order of making, a node's children beside each other; rows with a bin up to ``cut`` go left. ``column`` -1: a leaf."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    stats: np.ndarray
    gain: np.ndarray
    depth: np.ndarray

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        live = np.flatnonzero(self.column[at] >= 0)
        while len(live):
            node = at[live]
            at[live] = self.left[node] + (bins[live, self.column[node]] > self.cut[node])
            live = live[self.column[at[live]] >= 0]
        return at

    def values(self) -> np.ndarray:
        """Share of each class by node; a node without rows says nothing."""
        whole = self.stats.sum(axis=1, keepdims=True)
        return self.stats / np.where(whole > 0, whole, 1)

    def stopped(self, depth: int, min_gain: float) -> np.ndarray:
        """``column`` of this tree with less depth and a higher least gain, where sister leaves of one class are merged."""
        column = np.where((self.depth >= depth) | (self.gain < min_gain), -1, self.column)
        says = self.stats.argmax(axis=1)
        inner = np.flatnonzero(column >= 0)
        for level in range(int(self.depth.max()), -1, -1):
            n = inner[self.depth[inner] == level]
            kids = self.left[n]
            same = (column[kids] < 0) & (column[kids + 1] < 0) & (says[kids] == says[kids + 1])
            column[n[same]] = -1
        return column

    def ends(self, column: np.ndarray) -> np.ndarray:
        """For each node the node at which a row that comes through it stops in the tree of ``column``."""
        end, inner = np.arange(len(column)), np.flatnonzero(self.column >= 0)
        done = column < 0
        for level in range(int(self.depth.max())):
            n = inner[self.depth[inner] == level]
            n = n[done[n]]
            for kid in (self.left[n], self.left[n] + 1):
                end[kid], done[kid] = end[n], True
        return end

    def pruned(self) -> Tree:
        """Without the branches below sister leaves of one class."""
        column = self.stopped(1 << 30, 0.0)
        live = np.zeros(len(column), bool)
        live[0] = True
        for level in range(int(self.depth.max())):
            n = np.flatnonzero((self.depth == level) & live & (column >= 0))
            live[self.left[n]] = live[self.left[n] + 1] = True
        place = np.cumsum(live) - 1
        left = np.where(column >= 0, place[np.where(column >= 0, self.left, 0)], -1)
        return Tree(column[live], self.cut[live], left[live].astype(np.int32), self.stats[live], self.gain[live], self.depth[live])


def grow(x, y, w, c, key: np.ndarray, depth: int, shape: Shape, p: Params) -> Tree:
    """The tree below one node of class ``y``, weights ``w`` and counts ``c``, the node itself at ``depth``."""
    total = np.bincount(y, w if shape.by_class is None else c, shape.classes)[None]
    total = total if shape.by_class is None else total * shape.by_class
    count, size = np.array([c.sum()]), np.array([len(y)])
    made = {k: [] for k in ("column", "cut", "left", "gain")}
    stats, depths, first = [total], [np.array([depth])], 0
    key, done = np.asarray(key), 0
    open_ = splittable(total, count, depth, p)
    while len(size):
        n = len(size)
        column, cut, left, gain = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
        goes = np.zeros(n, bool)
        rows = np.repeat(open_, size)
        if not rows.all():
            x, y, w, c = x[rows], y[rows], w[rows], c[rows]
        todo, sizes = np.flatnonzero(open_), size[open_]
        kid_stats, kid_count = np.zeros((n, shape.classes)), np.zeros(n)
        columns = drawn(key[todo], len(shape.bins), shape.draw)
        cells = shape.bins[columns].sum(axis=1) * shape.classes + sizes * shape.draw
        part = (np.cumsum(cells) - 1) // CELLS
        edges = np.concatenate(([0], np.cumsum(sizes)))
        for i in np.unique(part):
            a, b = np.searchsorted(part, [i, i + 1])
            s, nodes = slice(edges[a], edges[b]), todo[a:b]
            hist = histograms(x[s], y[s], w[s], c[s], np.repeat(np.arange(b - a), sizes[a:b]), columns[a:b], shape)
            gain[nodes], column[nodes], cut[nodes], kid_stats[nodes], kid_count[nodes] = best_cuts(hist, total[nodes], count[nodes], columns[a:b], shape, p)
        goes = gain > 0
        column[~goes] = -1
        gain[~goes] = 0.0
        split = np.flatnonzero(goes)
        left[split] = done + n + 2 * np.arange(len(split))
        for k, v in zip(made, (column, cut, left, gain)):
            made[k].append(v)
        done += n
        depth += 1
        if not len(split):
            break
        # rows of each node: left ones first, in their order
        kept = np.repeat(goes[todo], sizes)
        if not kept.all():
            x, y, w, c = x[kept], y[kept], w[kept], c[kept]
        sizes = size[split]
        node = np.repeat(np.arange(len(split)), sizes)
        right = x[np.arange(len(x)), column[split][node]] > cut[split][node]
        order = np.argsort((node << 1) + right, kind="stable")
        x, y, w, c = x[order], y[order], w[order], c[order]
        size = np.bincount((node << 1) + right, minlength=2 * len(split))
        total = np.stack((kid_stats[split], total[split] - kid_stats[split]), axis=1).reshape(-1, shape.classes)
        count = np.stack((kid_count[split], count[split] - kid_count[split]), axis=1).ravel()
        total = np.maximum(total, 0)
        key = child_keys(key[split])
        stats.append(total)
        depths.append(np.full(len(size), depth))
        open_ = splittable(total, count, depth, p)
    small = {"column": np.int16, "cut": np.uint8, "left": np.int32, "gain": np.float64}
    return Tree(**{k: np.concatenate(v).astype(small[k]) for k, v in made.items()}, stats=np.concatenate(stats), depth=np.concatenate(depths).astype(np.int16))


# ---- rows -----------------------------------------------------------------------------------


def bin_edges(rows: DataFrame, columns: int) -> list[list[float]]:
    """Upper edges of the bins of each item of ``values``, from approximate quantiles of all rows in one pass; the last bin is open."""
    shares = [i / SHARES for i in range(SHARES + 1)]
    items = [F.get("values", F.lit(i)) for i in range(columns)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(x), x), shares, ACCURACY).alias(f"c{i}") for i, x in enumerate(items)]).first()
    out = []
    for cuts in found:
        values = np.unique(np.array(cuts or []))[:-1]
        if len(values) >= BINS:
            values = np.unique([cuts[i * SHARES // BINS] for i in range(1, BINS)])
        out.append(values.tolist())
    return out


def blocks(rows: DataFrame, edges: Sequence[Sequence[float]]) -> DataFrame:
    """``(block, bins, label, weight, fold)`` of ``(values, label, weight, fold)``: binned rows packed by batch."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = binned(np.array([np.asarray(v, np.float64) for v in pdf["values"]]).reshape(len(pdf), len(edges)), edges)
                yield pd.DataFrame({
                    "bins": [x.tobytes()], "label": [pdf["label"].to_numpy(np.int16).tobytes()],
                    "weight": [pdf["weight"].to_numpy(np.float64).tobytes()], "fold": [pdf["fold"].to_numpy(np.uint8).tobytes()],
                })

    packed = rows.select("values", "label", "weight", "fold").mapInPandas(pack, "bins binary, label binary, weight binary, fold binary")
    return written(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


def opened(record: tuple, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    _, bins, label, weight, fold = record
    return np.frombuffer(bins, np.uint8).reshape(-1, columns), np.frombuffer(label, np.int16), np.frombuffer(weight), np.frombuffer(fold, np.uint8)


def taken(record: tuple, columns: int, seed: int, number: int, out: int | None) -> tuple:
    """``(bins, class, weight, count)`` of a block's rows that are in a tree's bootstrap; rows of fold ``out`` never are."""
    x, y, w, fold = opened(record, columns)
    c = np.random.default_rng([seed & 0xFFFFFFFF, number, record[0]]).poisson(1.0, len(y))
    if out is not None:
        c = np.where(fold == out, 0, c)
    at = np.flatnonzero(c)
    c = c[at].astype(np.float64)
    return x[at], y[at].astype(np.int64), w[at] * c, c


class Grower:
    """Makes waves of trees over written blocks; rows of fold ``out`` are left out."""

    def __init__(self, table: DataFrame, edges: Sequence[Sequence[float]], p: Params, classes: int, n: int, by_class: np.ndarray | None, out: int | None = None):
        self.spark, self.p, self.n, self.out = table.sparkSession, p, n, out
        self.sc = self.spark.sparkContext
        # a bin for missing values, one below each edge, one above the last
        self.shape = Shape(classes, np.array([len(e) + 2 for e in edges]), by_class, p.columns(len(edges)))
        self.blocks = table.select("block", "bins", "label", "weight", "fold").rdd.map(tuple)
        self.held = None

    def waves(self) -> Iterator[RDD | list[tuple[int, Tree]]]:
        """The numbered trees of each wave: to be made in tasks that hold the whole table, or made already."""
        if self.n <= LOCAL_ROWS:
            self.held = self.sc.broadcast(sorted(self.blocks.collect()))
        step = max(1, WAVE_ROWS // max(1, self.n))
        try:
            for at in range(0, self.p.trees, step):
                numbers = range(at, min(at + step, self.p.trees))
                yield self._whole(numbers) if self.held else self._by_parts(numbers)
        finally:
            if self.held:
                self.held.unpersist()

    def _whole(self, numbers: range) -> RDD:
        held, p, shape, out = self.held, self.p, self.shape, self.out

        def run(number: int) -> tuple[int, Tree]:
            rows = [taken(r, len(shape.bins), p.seed, number, out) for r in held.value]
            return number, grow(*map(np.concatenate, zip(*rows)), root_key(p.seed, number), 0, shape, p)

        return self.sc.parallelize(numbers, min(len(numbers), 8 * self.sc.defaultParallelism)).map(run)

    def _by_parts(self, numbers: range) -> list[tuple[int, Tree]]:
        p, shape, out, columns = self.p, self.shape, self.out, len(self.shape.bins)
        heads = {i: Head(root_key(p.seed, i)) for i in numbers}
        large = [(i, 0) for i in numbers]
        small: list[tuple[int, int]] = []
        width = self.sc.defaultParallelism * 2
        while large:
            looked = {(i, n): drawn(heads[i].key[n], columns, shape.draw) for i, n in large}
            state = self.sc.broadcast(({i: heads[i].tree(shape) for i in {i for i, _ in large}}, looked))

            def count(record: tuple) -> Iterator[tuple]:
                trees, wanted = state.value
                for i, tree in trees.items():
                    x, y, w, c = taken(record, columns, p.seed, i, out)
                    leaf = tree.route(x)
                    for n in [n for j, n in wanted if j == i]:
                        at = np.flatnonzero(leaf == n)
                        if len(at):
                            yield (i, n), histograms(x[at], y[at], w[at], c[at], np.zeros(len(at), np.int64), wanted[i, n], shape)

            def cut(item: tuple) -> tuple:
                (i, n), sums = item
                looked_at = state.value[1][i, n]
                total, rows = weighed(sums[: shape.bins[looked_at[0, 0]]].sum(axis=0)[None], shape)
                gain, column, at, left, left_rows = best_cuts(sums, total, rows, looked_at, shape, p)
                return i, n, total[0], rows[0], float(gain[0]), int(column[0]), int(at[0]), left[0], left_rows[0]

            found = self.blocks.flatMap(count).reduceByKey(lambda a, b: a + b, min(width, len(large))).map(cut).collect()
            large = []
            for i, n, total, rows, gain, column, at, left, left_rows in sorted(found, key=lambda f: f[:2]):
                head = heads[i]
                head.stats[n] = total
                if gain <= 0 or not splittable(total[None], rows[None], head.depth[n], p)[0]:
                    continue
                for kid, stats, kid_rows in zip(head.split(n, gain, column, at), (left, np.maximum(total - left, 0)), (left_rows, rows - left_rows)):
                    head.stats[kid] = stats
                    if splittable(stats[None], kid_rows[None], head.depth[kid], p)[0]:
                        # distinct rows are fewer than counts
                        (large if kid_rows > LOCAL_ROWS else small).append((i, kid))
            state.unpersist()
        state = self.sc.broadcast({i: (heads[i].tree(shape), [n for j, n in small if j == i]) for i in {i for i, _ in small}})
        keys = {(i, n): (heads[i].key[n], heads[i].depth[n]) for i, n in small}

        def deal(record: tuple) -> Iterator[tuple]:
            for i, (tree, wanted) in state.value.items():
                rows = taken(record, columns, p.seed, i, out)
                leaf = tree.route(rows[0])
                for n in wanted:
                    at = np.flatnonzero(leaf == n)
                    if len(at):
                        yield (i, n), (record[0], *(v[at] for v in rows))

        def finish(item: tuple) -> tuple:
            name, parts = item
            rows = [part[1:] for part in sorted(parts, key=lambda part: part[0])]
            key, depth = keys[name]
            return name, grow(*map(np.concatenate, zip(*rows)), key, depth, shape, p)

        below = self.blocks.flatMap(deal).groupByKey(max(1, min(len(small), 32 * width))).map(finish).collect() if small else []
        state.unpersist()
        for (i, n), tree in sorted(below, key=lambda b: b[0]):
            heads[i].below[n] = tree
        return [(i, heads[i].tree(shape)) for i in numbers]


@dataclass
class Head:
    """The upper nodes of a tree, as they are split on the driver; ``below`` has what was grown in tasks."""

    root: np.ndarray
    column: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])
    stats: dict[int, np.ndarray] = field(default_factory=dict)
    below: dict[int, Tree] = field(default_factory=dict)

    def __post_init__(self):
        self.key = [self.root]

    def split(self, n: int, gain: float, column: int, cut: int) -> tuple[int, int]:
        self.column[n], self.cut[n], self.left[n], self.gain[n] = column, cut, len(self.column), gain
        kids = child_keys(self.key[n])
        for kid in (0, 1):
            for values, first in ((self.column, -1), (self.cut, 0), (self.left, -1), (self.gain, 0.0), (self.depth, self.depth[n] + 1)):
                values.append(first)
            self.key.append(kids[kid : kid + 1])
        return self.left[n], self.left[n] + 1

    def tree(self, shape: Shape) -> Tree:
        none = np.zeros(shape.classes)
        parts = [Tree(
            np.array(self.column, np.int16), np.array(self.cut, np.uint8), np.array(self.left, np.int32),
            np.array([self.stats.get(n, none) for n in range(len(self.column))]), np.array(self.gain), np.array(self.depth, np.int16),
        )]
        size = len(self.column)
        for n, tree in self.below.items():
            # the first node of what was grown below takes the place of the leaf, the others follow at the end
            left = np.where(tree.column >= 0, tree.left + size - 1, -1).astype(np.int32)
            for name in ("column", "cut", "stats", "gain"):
                getattr(parts[0], name)[n] = getattr(tree, name)[0]
            parts[0].left[n] = left[0]
            parts.append(Tree(tree.column[1:], tree.cut[1:], left[1:], tree.stats[1:], tree.gain[1:], tree.depth[1:]))
            size += len(tree.column) - 1
        return Tree(*(np.concatenate([getattr(t, name) for t in parts]) for name in ("column", "cut", "left", "stats", "gain", "depth")))


# ---- models ---------------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees over binned columns, kept in broadcasts of one wave each; a row's class shares are the mean over its leaves."""

    edges: list[list[float]]
    classes: int
    trees: int
    nodes: int
    #: by wave: a broadcast of trees ``(column, cut, left, class shares)``
    waves: list
    featureImportances: DenseVector  # noqa: N815  the name that other models use

    def score(self, df: DataFrame, features: str, name: str) -> DataFrame:
        """Add the class shares of the vectors in ``features``; rows are gathered, then each wave of trees is read once for them."""
        edges, classes, waves = self.edges, self.classes, self.waves

        def votes(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), classes))
            for wave in waves:
                # a forest may be larger than a task's memory, so a wave is let go after its rows when there are others
                for column, cut, left, value in wave.value if len(waves) == 1 else wave.load_from_path(wave._path):
                    out += value[Tree(column, cut, left, value, value, value).route(x)]
            whole = out.sum(axis=1, keepdims=True)
            return np.where(whole > 0, out / np.where(whole > 0, whole, 1), 1 / classes)

        @F.pandas_udf("array<double>")
        def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held: list[np.ndarray] = []

            def scored() -> Iterator[pd.Series]:
                if held:
                    found = votes(np.concatenate(held))
                    for part in np.split(found, np.cumsum([len(x) for x in held])[:-1]):
                        yield pd.Series(list(part))
                    held.clear()

            for batch in batches:
                held.append(binned(np.array([np.asarray(v, np.float64) for v in batch]).reshape(len(batch), len(edges)), edges))
                if sum(map(len, held)) >= SCORE_ROWS:
                    yield from scored()
            yield from scored()

        return df.withColumn(name, shares(vector_to_array(features)))


def prepared(train: DataFrame, weight: str | None, fold: str | None = None) -> tuple[DataFrame, int, int, np.ndarray | None, int]:
    """``(rows, columns, classes, weights by class, number)`` of ``(features, label, weight)``; weights by class where equal labels weigh the same."""
    rows = train.select(
        vector_to_array("features").alias("values"), F.col("label").cast("double").alias("label"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), (F.col(fold) if fold else F.lit(0)).alias("fold"),
    )
    seen = rows.groupBy("label").agg(F.max(F.size("values")).alias("m"), F.min("weight").alias("low"), F.max("weight").alias("high"), F.count("*").alias("n")).collect()
    if not seen:
        raise ValueError("no rows")
    if any(r["label"] is None or r["label"] < 0 or not r["label"].is_integer() for r in seen):
        raise ValueError("labels must be whole numbers from 0")
    classes = max(2, 1 + int(max(r["label"] for r in seen)))
    by_class = np.ones(classes)
    for r in seen:
        by_class[int(r["label"])] = r["low"]
    same = all(r["low"] == r["high"] for r in seen)
    return rows, max(r["m"] for r in seen), classes, by_class if same else None, sum(r["n"] for r in seen)


def packed(tree: Tree, columns: int) -> tuple[tuple, np.ndarray]:
    """What scoring needs of a tree without its needless branches, and the share of each column in its gain."""
    tree = tree.pruned()
    inner = tree.column >= 0
    gains = np.bincount(tree.column[inner], (tree.gain * tree.stats.sum(axis=1))[inner], columns)
    return (tree.column, tree.cut, tree.left, tree.values().astype(np.float32)), gains / (gains.sum() or 1.0)


def fit(train: DataFrame, p: Params, weight: str | None = None) -> Forest:
    """Forest of ``(features, label, weight)``, labels 0, 1, ...; reruns over the same partitions agree."""
    rows, columns, classes, by_class, n = prepared(train, weight)
    edges = bin_edges(rows, columns)
    grower = Grower(blocks(rows, edges), edges, p, classes, n, by_class)
    waves, nodes, importance = [], 0, np.zeros(columns)
    for trees in grower.waves():
        made = [packed(t, columns) for _, t in trees] if isinstance(trees, list) else trees.map(lambda t: packed(t[1], columns)).collect()
        importance += sum(shares for _, shares in made)
        nodes += sum(len(arrays[0]) for arrays, _ in made)
        # a file by now, which the driver does not hold
        waves.append(grower.sc.broadcast([arrays for arrays, _ in made]))
    return Forest(edges, classes, p.trees, nodes, waves, Vectors.dense(importance / (importance.sum() or 1.0)))


# ---- search ---------------------------------------------------------------------------------

#: Parameters of a point that need trees of their own; by the others only a forest's head is taken or branches are cut off.
OWN = ("minInstancesPerNode", "impurity")
HEADS = ("numTrees", "maxDepth", "minInfoGain")


def _votes(x: np.ndarray, trees: Iterator[tuple[int, Tree]], cuts: Sequence[tuple[int, float]], heads: Sequence[int], classes: int) -> np.ndarray:
    """Sums of class shares of rows ``x`` by cut, and by which of the ``heads`` is the first to have the tree."""
    out = np.zeros((len(cuts), len(heads), len(x), classes))
    for number, tree in trees:
        leaf, value, head = tree.route(x), tree.values(), int(np.searchsorted(heads, number, "right"))
        for i, (depth, gain) in enumerate(cuts):
            out[i, head] += value[tree.ends(tree.stopped(depth, gain))[leaf]]
    return out


def _counts(item: tuple, heads: Sequence[int]) -> Iterator[tuple]:
    """``((cut, head), [tp, fp, fn])`` of summed votes; of equal votes the first class is said."""
    (cut, _), (y, votes) = item
    for head, sums in zip(heads, votes.cumsum(axis=0)):
        says, is_ = sums.argmax(axis=1) == 1, y == 1
        yield (cut, head), np.array([(says & is_).sum(), (says & ~is_).sum(), (~says & is_).sum()])


def _f1(tp: int, fp: int, fn: int) -> float:
    precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def _fold(grower: Grower, cuts: Sequence[tuple[int, float]], heads: Sequence[int]) -> dict[tuple, float]:
    """F1 of class 1 in the rows that ``grower`` leaves out, by ``(cut, head)``. Only counts reach the driver in the end."""
    spark, classes, out, columns = grower.spark, grower.shape.classes, grower.out, len(grower.shape.bins)
    parts = []

    def left_out(record: tuple) -> tuple[np.ndarray, np.ndarray]:
        x, y, _, fold = opened(record, columns)
        return x[fold == out], y[fold == out]

    def add(a: tuple, b: tuple) -> tuple:
        return a[0], a[1] + b[1]

    def kept(item: tuple) -> tuple:
        (cut, block), (y, votes) = item
        return int(cut), int(block), y.tobytes(), votes.astype(np.float64).tobytes()

    def back(row: tuple) -> tuple:
        y = np.frombuffer(row[2], np.int16)
        return (row[0], row[1]), (y, np.frombuffer(row[3]).reshape(len(heads), len(y), classes))

    for trees in grower.waves():
        if isinstance(trees, list):
            wave = grower.sc.broadcast(trees)

            def by_block(record: tuple) -> Iterator[tuple]:
                x, y = left_out(record)
                for cut, votes in enumerate(_votes(x, wave.value, cuts, heads, classes)):
                    yield (cut, record[0]), (y, votes)

            found = grower.blocks.flatMap(by_block)
        else:
            held = grower.held

            def by_tree(some: Iterator[tuple]) -> Iterator[tuple]:
                x, y = map(np.concatenate, zip(*map(left_out, held.value)))
                for cut, votes in enumerate(_votes(x, some, cuts, heads, classes)):
                    yield (cut, 0), (y, votes)

            found = trees.mapPartitions(by_tree).reduceByKey(add, len(cuts))
        parts.append(written(spark.createDataFrame(found.map(kept), "cut int, block long, label binary, votes binary"), "votes"))
        if isinstance(trees, list):
            wave.unpersist()
    sums = spark.sparkContext.union([p.rdd.map(tuple).map(back) for p in parts]).reduceByKey(add)
    counts = sums.flatMap(lambda item: _counts(item, heads)).reduceByKey(lambda a, b: a + b).collect()
    return {name: _f1(*map(int, c)) for name, c in counts}


def search(train: DataFrame, points: Sequence[Mapping], folds: int, seed: int) -> list[float]:
    """Mean F1 of class 1 over the folds by point: what a cross-validation of a forest for each point gives.

    The forests of one fold that differ in ``HEADS`` only are one forest of the most trees, the most depth and the least gain.
    """
    lot = F.least(F.floor(F.rand(seed) * folds), F.lit(folds - 1)).cast("int")
    dealt = written(train.select("features", "label", lot.alias("fold")), "folds")
    rows, columns, classes, _, n = prepared(dealt, None, "fold")
    plans = [{"numTrees": 20, "maxDepth": 5, "minInfoGain": 0.0, "minInstancesPerNode": 1, "impurity": "gini"} | dict(p) for p in points]
    marks = np.zeros((folds, len(points)))
    for fold in range(folds):
        edges = bin_edges(rows.where(F.col("fold") != fold), columns)
        table = blocks(rows, edges)
        for own in sorted({tuple(p[k] for k in OWN) for p in plans}):
            mine = {i: p for i, p in enumerate(plans) if tuple(p[k] for k in OWN) == own}
            cuts, heads = sorted({(p["maxDepth"], p["minInfoGain"]) for p in mine.values()}), sorted({p["numTrees"] for p in mine.values()})
            # one tree alone looks at all columns, so it is a forest of its own
            for some in [h for h in ([1] if 1 in heads else [], [h for h in heads if h > 1]) if h]:
                p = Params(some[-1], max(d for d, _ in cuts), own[0], min(g for _, g in cuts), own[1], seed=seed)
                f1 = _fold(Grower(table, edges, p, classes, n, np.ones(classes), fold), cuts, some)
                for i, q in mine.items():
                    if q["numTrees"] in some:
                        marks[fold, i] = f1[cuts.index((q["maxDepth"], q["minInfoGain"])), q["numTrees"]]
    return marks.mean(axis=0).tolist()

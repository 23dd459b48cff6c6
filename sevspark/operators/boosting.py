"""Gradient-boosted trees on distributed histograms: leaf-wise or depth-wise, with second-order regularised gain.

Columns are binned once (at most ``BINS`` bins each, missing values in a bin of their own). Rows are packed into blocks of
bounded size that stay in a written table; a tree is grown by jobs over these blocks. A job returns, for all leaves that wait
to be split, sums of gradients and hessians by column and bin, added up in Spark, so what reaches the driver is a histogram
whose size does not depend on the rows. Of two sisters only the smaller one is counted, the other is the parent less that one.

Leaf-wise growth is best-first: the leaf with the highest gain is split next until the tree has its leaves. One job serves all
leaves that the order, as far as it is known, would split next, so a tree takes about as many jobs as it is deep.
Executors need this package: the margins of their blocks are kept in its workers between jobs.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

BINS = 255
#: Rows of one block: what a task holds as arrays at once.
BLOCK_ROWS = 65_536
#: Rows for which a task is worth starting: tables of few rows are served by few tasks.
TASK_ROWS = 32_768
#: Error of the quantiles that cut a column into bins: one in so many rows.
ACCURACY = 10_000


@dataclass(frozen=True)
class Params:
    """Regularised gain of a split: with G, H the sums of a side, soft(G)^2 / (H + l2), summed, less the parent's, halved, less gamma."""

    rounds: int = 100
    rate: float = 0.1
    leaves: int | None = None
    depth: int | None = None
    l1: float = 0.0
    l2: float = 0.0
    gamma: float = 0.0
    min_hessian: float = 0.0
    min_rows: int = 1
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in order of making: column and bin to split at (rows with a bin up to it go left), children, value of a leaf."""

    column: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, cut: int, values: tuple[float, float]) -> tuple[int, int]:
        self.column[node], self.cut[node] = column, cut
        self.left[node], self.right[node] = len(self.value), len(self.value) + 1
        for v in values:
            for column_, first in ((self.column, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, v)):
                column_.append(first)
        return self.left[node], self.right[node]

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        column, cut, left, right = (np.asarray(x) for x in (self.column, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        live = np.flatnonzero(column[at] >= 0)
        while len(live):
            node = at[live]
            goes = bins[live, column[node]] <= cut[node]
            at[live] = np.where(goes, left[node], right[node])
            live = live[column[at[live]] >= 0]
        return at

    def finished(self) -> Tree:
        """The same tree as arrays, which are small to send and quick to read."""
        return Tree(*(np.array(x, np.float64 if x is self.value else np.int32) for x in (self.column, self.cut, self.left, self.right, self.value)))

    @property
    def leaves(self) -> int:
        return sum(c < 0 for c in self.column)


@dataclass
class Boosted:
    """Trees over binned columns; the margin of a row is the sum of a base and its leaf values."""

    edges: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    #: total gain by column
    gains: np.ndarray | None = None

    def score(self, df: DataFrame, features: Sequence[str], name: str = "severe_probability") -> DataFrame:
        """Add the probability of class 1, made in Arrow batches from the columns in the order of training."""
        held = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def probability(*columns: pd.Series) -> pd.Series:
            model = held.value
            x = binned(np.column_stack([c.to_numpy(np.float64) for c in columns]), model.edges)
            return pd.Series(1 / (1 + np.exp(-grown(np.full(len(x), model.base), x, model.trees))))

        return df.withColumn(name, probability(*[F.col(f).cast("double") for f in features]))

    def importances(self, features: Sequence[str]) -> list[tuple[str, float]]:
        """Share of the total gain by feature, falling."""
        total = self.gains.sum() or 1.0
        return sorted(((f, float(g / total)) for f, g in zip(features, self.gains)), key=lambda x: (-x[1], x[0]))


def grown(margins: np.ndarray, bins: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    for tree in trees:
        margins = margins + np.asarray(tree.value)[tree.route(bins)]
    return margins


def binned(x: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin of every value: 0 for a missing one, 1 + the number of edges below it for the others."""
    out = np.empty(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(x[:, i]), 0, 1 + np.searchsorted(np.asarray(e), x[:, i], "left"))
    return out


def bin_edges(rows: DataFrame, columns: int) -> list[list[float]]:
    """Upper edges of the bins of each item of ``values``, from approximate quantiles of all rows in one pass; the last bin is open."""
    shares = [i / (BINS - 1) for i in range(1, BINS - 1)]
    items = [F.get("values", F.lit(i)) for i in range(columns)]
    cuts = rows.agg(*[F.percentile_approx(F.when(~F.isnan(x), x), shares, ACCURACY).alias(f"c{i}") for i, x in enumerate(items)])
    return [sorted(set(row or [])) for row in cuts.first()]


def blocks(rows: DataFrame, edges: Sequence[Sequence[float]], weight: str | None) -> DataFrame:
    """``(block, bins, label, weight)`` of ``(values, label, weight)``: binned rows packed into blocks of at most ``BLOCK_ROWS``."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[at : at + BLOCK_ROWS]
                x = binned(np.array([np.asarray(v, np.float64) for v in part["values"]]).reshape(len(part), len(edges)), edges)
                yield pd.DataFrame({"bins": [x.tobytes()], "label": [part["label"].to_numpy(np.float64).tobytes()], "weight": [part["weight"].to_numpy(np.float64).tobytes()]})

    given = rows.select("values", F.col("label").cast("double"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    packed = given.mapInPandas(pack, "bins binary, label binary, weight binary")
    return written(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


def soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def leaf_value(g: float, h: float, p: Params) -> float:
    return float(-soft(np.float64(g), p.l1) / (h + p.l2) * p.rate) if h + p.l2 > 0 else 0.0


def best_split(hist: np.ndarray, starts: np.ndarray, p: Params, columns: np.ndarray) -> tuple[float, int, int]:
    """``(gain, column, bin)`` of a leaf's best split; gain 0 for none.

    ``hist`` holds ``[g, h, rows]`` of all bins, those of column i from ``starts[i]`` to ``starts[i + 1]``.
    """
    sums = np.concatenate((np.zeros((1, 3)), hist.cumsum(axis=0)))
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    left = sums[1:] - sums[starts[owner]]
    total = sums[starts[1]]
    right = total - left

    def strength(side: np.ndarray) -> np.ndarray:
        below = side[..., 1] + p.l2
        return np.where(below > 0, soft(side[..., 0], p.l1) ** 2 / np.where(below > 0, below, 1), 0)

    gain = 0.5 * (strength(left) + strength(right) - strength(total)) - p.gamma
    allowed = columns[owner]
    for side in (left, right):
        allowed &= (side[:, 2] >= max(1, p.min_rows) - 0.5) & (side[:, 1] >= p.min_hessian)
    at = int(np.argmax(np.where(allowed, gain, -np.inf)))
    best = float(gain[at]) if allowed[at] else 0.0
    return (best, int(owner[at]), at - int(starts[owner[at]])) if best > 1e-12 else (0.0, -1, 0)


#: Margins of blocks as of so many trees, kept in a Python worker between jobs; made anew wherever they are missing.
_MARGINS: dict[tuple, tuple[int, np.ndarray]] = {}
MARGIN_BYTES = 256 << 20


def _margins(run: str, block: int, bins: np.ndarray, base: float, trees: Sequence) -> np.ndarray:
    """Margins of a block after ``trees``, given as broadcast chunks of ``CHUNK`` trees and a list of the last ones."""
    chunks, recent = trees
    n, margins = _MARGINS.get((run, block), (0, np.full(len(bins), base)))
    for i in range(n // CHUNK, len(chunks)):
        margins = grown(margins, bins, chunks[i].value[n - i * CHUNK :])
        n = (i + 1) * CHUNK
    margins = grown(margins, bins, recent[n - len(chunks) * CHUNK :])
    if sum(m.nbytes for _, m in _MARGINS.values()) > MARGIN_BYTES or any(k[0] != run for k in _MARGINS):
        _MARGINS.clear()
    _MARGINS[run, block] = (len(chunks) * CHUNK + len(recent), margins)
    return margins


#: Finished trees that one broadcast holds; a job itself ships fewer than these.
CHUNK = 16


class Grower:
    """Grows one tree after the other over written blocks."""

    def __init__(self, table: DataFrame, model: Boosted, p: Params, n: int):
        self.model, self.p, self.run = model, p, uuid.uuid4().hex
        self.sc = table.sparkSession.sparkContext
        # a few large records that every job reads again, without planning a query each time
        records = table.select("block", "bins", "label", "weight").rdd.map(tuple)
        self.blocks = records.coalesce(min(records.getNumPartitions(), -(-n // TASK_ROWS))).persist()
        self.depth = 1 if self.blocks.getNumPartitions() <= 16 else 2
        self.chunks: list = []
        self.columns = len(model.edges)
        #: where the bins of each column start: a bin for missing values, one below each edge, one above the last
        self.starts = np.cumsum([0] + [len(e) + 2 for e in model.edges])

    def close(self) -> None:
        self.blocks.unpersist()
        for chunk in self.chunks:
            chunk.unpersist()

    def add(self, tree: Tree) -> None:
        self.model.trees.append(tree)
        if len(self.model.trees) % CHUNK == 0:
            self.chunks.append(self.sc.broadcast(self.model.trees[-CHUNK:]))

    def histograms(self, tree: Tree, nodes: Sequence[int], number: int) -> dict[int, np.ndarray]:
        """Sums of gradient, hessian and rows by column and bin for the leaves ``nodes`` of the unfinished ``tree``."""
        p, run, base, columns, starts = self.p, self.run, self.model.base, self.columns, self.starts
        trees = (self.chunks, self.model.trees[len(self.chunks) * CHUNK :])
        place = np.full(len(tree.value), -1)
        place[list(nodes)] = np.arange(len(nodes))
        width = int(starts[-1])
        size = len(nodes) * width

        def count(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
            out = np.zeros((3, size))
            for block, bins, label, weight in rows:
                x = np.frombuffer(bins, np.uint8).reshape(-1, columns)
                prob = 1 / (1 + np.exp(-_margins(run, block, x, base, trees)))
                y, w = np.frombuffer(label), np.frombuffer(weight)
                leaf = place[tree.route(x)]
                if p.row_share < 1:
                    leaf = np.where(np.random.default_rng([p.seed, number, block]).random(len(y)) < p.row_share, leaf, -1)
                take = np.flatnonzero(leaf >= 0)
                at = (x[take] + starts[:-1] + (leaf[take] * width)[:, None]).ravel()
                for i, values in enumerate((w * (prob - y), w * prob * (1 - prob), None)):
                    out[i] += np.bincount(at, None if values is None else np.repeat(values[take], columns), size)
            yield out

        zero = np.zeros((3, size))
        total = self.blocks.mapPartitions(count).treeAggregate(zero, lambda a, b: a + b, lambda a, b: a + b, self.depth)
        return {n: total[:, i * width : (i + 1) * width].T for i, n in enumerate(nodes)}

    def tree(self, number: int) -> tuple[Tree, np.ndarray]:
        """The next tree and the gain of each column in it.

        ``wide`` holds all splits whose outcome is known. The order of best-first growth is played over it; leaves that the order
        reaches and whose children are unknown are split, all in one job, and the order is played again until it knows all.
        """
        p, wide = self.p, Tree()
        draw = np.random.default_rng([p.seed, number]).permutation(self.columns)
        columns = np.zeros(self.columns, bool)
        columns[draw[: max(1, math.ceil(p.column_share * self.columns))]] = True
        hist = self.histograms(wide, [0], number)
        best, depth = {0: best_split(hist[0], self.starts, p, columns)}, {0: 0}
        wide.value[0] = leaf_value(*hist[0][: self.starts[1]].sum(axis=0)[:2], p)
        while True:
            order, unknown = self._order(wide, best, depth)
            if not unknown:
                break
            fewer = {}
            for n in unknown:
                _, column, cut = best[n]
                sums = hist[n][self.starts[column] : self.starts[column + 1]].cumsum(axis=0)
                sides = [sums[cut], sums[-1] - sums[cut]]
                kids = wide.split(n, column, cut, tuple(leaf_value(*side[:2], p) for side in sides))
                depth |= dict.fromkeys(kids, depth[n] + 1)
                fewer[kids[int(sides[1][2] < sides[0][2])]] = (n, kids)
            counted = self.histograms(wide, list(fewer), number)
            for node, (up, kids) in fewer.items():
                hist[node] = counted[node]
                hist[sum(kids) - node] = hist.pop(up) - counted[node]
                best |= {kid: best_split(hist[kid], self.starts, p, columns) for kid in kids}
        tree, at, gains = Tree(value=[wide.value[0]]), {0: 0}, np.zeros(self.columns)
        for n in order:
            gain, column, cut = best[n]
            gains[column] += gain
            kids = (wide.left[n], wide.right[n])
            at |= dict(zip(kids, tree.split(at[n], column, cut, tuple(wide.value[k] for k in kids))))
        return tree, gains

    def _order(self, wide: Tree, best: dict, depth: dict) -> tuple[list[int], list[int]]:
        """Nodes in the order in which best-first growth splits them, and those among them whose children are unknown."""
        most = self.p.leaves or 2 ** self.p.depth
        order, unknown, heap = [], [], [(-best[0][0], 0)]
        while heap and len(order) < most - 1:
            gain, n = heapq.heappop(heap)
            if gain >= 0:
                break
            if self.p.depth is not None and depth[n] >= self.p.depth:
                continue
            order.append(n)
            if wide.column[n] < 0:
                unknown.append(n)
            else:
                for kid in (wide.left[n], wide.right[n]):
                    heapq.heappush(heap, (-best[kid][0], kid))
        return order, unknown


def fit(rows: DataFrame, p: Params, weight: str | None = None) -> Boosted:
    """Model of ``(values, label, weight)``: ``values`` an array of numbers, null or NaN where missing, ``label`` 0 or 1.

    Rows without a label are left out; a table of one class gives a constant. Reruns agree up to the order of sums.
    """
    if not p.leaves and not p.depth:
        raise ValueError("give leaves, depth or both")
    rows = rows.where("label is not null")
    w = F.col(weight) if weight else F.lit(1.0)
    first = rows.agg(F.max(F.size("values")).alias("n"), F.sum(w * F.col("label")).alias("one"), F.sum(w).alias("all"), F.count("*").alias("rows")).first()
    if not first["n"]:
        raise ValueError("no rows")
    share = min(max(first["one"] / first["all"], 1e-9), 1 - 1e-9)
    model = Boosted(bin_edges(rows, first["n"]), math.log(share / (1 - share)), gains=np.zeros(first["n"]))
    grower = Grower(blocks(rows, model.edges, weight), model, p, first["rows"])
    try:
        for number in range(p.rounds):
            tree, gains = grower.tree(number)
            model.gains += gains
            grower.add(tree.finished())
    finally:
        grower.close()
    return model

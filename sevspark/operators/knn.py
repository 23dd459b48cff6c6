"""Exact nearest neighbours as a join: pivot cells, triangle-inequality bounds, searches in blocks of bounded size.

1. At most ``PIVOTS`` rows of the searched side are pivots; every row belongs to the cell of its nearest pivot, every cell is
   cut into chunks of about ``CHUNK`` rows.
2. Each query searches one chunk of its own cell. Its kth distance there bounds the true one from above.
3. A query is then sent to those chunks only whose cell can hold a row within that bound: by the triangle inequality over the
   cell's least and greatest distance to its pivot and, for Euclidean distance, by the plane between two pivots.
4. What is found within the bound is ranked by distance, then key.

Rows of one vector are one class with its k least keys, which no result can exceed, so copies of a row cost nothing, however
many. Pivots and one row per cell are all that the driver sees. How many cells a query reaches depends on the data; where
distances concentrate it is all of them and the work is rows times rows, in blocks.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The size of a reduced train set by default; the join itself takes any number.
SAMPLE_LIMIT = 5000
PIVOTS = 1024
#: Rows of one task on either side.
CHUNK = 8192
METRICS = ("minkowski", "manhattan", "chebyshev")
#: Bounds are widened by this share, so that rounding cannot cut off a neighbour.
SLACK = 1e-9


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of every row of ``a`` to every row of ``b``, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        diff = np.abs(a[i : i + step, None, :] - b[None, :, :])
        if metric == "minkowski":
            out[i : i + step] = np.sqrt((diff * diff).sum(axis=2))
        elif metric == "manhattan":
            out[i : i + step] = diff.sum(axis=2)
        else:
            out[i : i + step] = diff.max(axis=2)
    return out


class Cells:
    """Pivots with the least and greatest distance of the searched rows in their cells, and each cell's chunks."""

    def __init__(self, pivots: np.ndarray, metric: str):
        self.pivots, self.metric = pivots, metric
        self.apart = _distances(pivots, pivots, metric)
        self.low = np.full(len(pivots), np.inf)
        self.high = np.full(len(pivots), -np.inf)
        self.chunks = np.zeros(len(pivots), np.int64)

    def fill(self, summary: Sequence) -> None:
        for row in summary:
            self.low[row["cell"]], self.high[row["cell"]] = row["low"], row["high"]
            self.chunks[row["cell"]] = -(-row["n"] // CHUNK)

    def reachable(self, away: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which cells may hold a row within ``bound`` of rows whose distances to the pivots are ``away``."""
        least = np.maximum(away - self.high[None, :], self.low[None, :] - away)
        if self.metric == "minkowski":
            own = away.argmin(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (away**2 - away.min(axis=1)[:, None] ** 2) / (2 * self.apart[own])
            least = np.maximum(least, np.nan_to_num(plane, nan=0.0, posinf=0.0, neginf=0.0))
        room = np.abs(away) * SLACK + 1e-12
        return (self.chunks > 0)[None, :] & (least <= bound[:, None] * (1 + SLACK) + room)


def _classes(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``(vid, vec, keys)``: each distinct vector once, with its ``k`` least keys; ``vid`` is the least. No null vectors."""
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec")).where("vec is not null")
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("key"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    keys = few.groupBy("vec").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return keys.select(F.col("keys")[0].alias("vid"), "vec", "keys")


def _celled(classes: DataFrame, cells: Cells) -> DataFrame:
    """Add ``cell`` and the distance ``away`` from its pivot."""
    held = classes.sparkSession.sparkContext.broadcast(cells)
    extra = [f.name for f in classes.schema if f.name not in ("vid", "vec")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                away = _distances(_matrix(part["vec"]), c.pivots, c.metric)
                near = away.argmin(axis=1)
                yield part.assign(cell=near.astype("int32"), away=away[np.arange(len(part)), near])

    kinds = "vid long, vec array<double>" + (", keys array<long>" if extra else "")
    return classes.mapInPandas(run, kinds + ", cell int, away double")


def _search(k: int, metric: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of the rows of one chunk the ``k`` nearest keys within its ``bound`` for each query."""
    last = np.iinfo(np.int64).max

    def run(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(s):
            s = s.sort_values("vid", ignore_index=True)
            y, owner = _matrix(s["vec"]), s["vid"].to_numpy(np.int64)
            keys = np.full((len(s), k), last)
            for row, own in zip(keys, s["keys"]):
                row[: len(own)] = own
            step = max(1, 2_000_000 // len(s))
            for at in range(0, len(q), step):
                part = q.iloc[at : at + step]
                away = _distances(_matrix(part["vec"]), y, metric)
                # a class that is not among the k nearest has k others before it
                near = np.argsort(away, axis=1, kind="stable")[:, :k]
                dist = np.repeat(np.take_along_axis(away, near, 1), k, axis=1)
                ids, of = keys[near].reshape(len(part), -1), np.repeat(owner[near], k, axis=1)
                dist = np.where(ids == last, np.inf, dist)
                order = np.lexsort((ids, dist), axis=1)[:, :k]
                dist, ids, of = (np.take_along_axis(x, order, 1) for x in (dist, ids, of))
                bound = part["bound"].to_numpy() * (1 + SLACK) + 1e-12
                row, col = np.nonzero((ids != last) & (dist <= bound[:, None]))
                found.append(pd.DataFrame({"vid": part["vid"].to_numpy()[row], "dist": dist[row, col], "nn_id": ids[row, col], "nn_vid": of[row, col]}))
        if found:
            return pd.concat(found, ignore_index=True)
        return pd.DataFrame({"vid": [], "dist": [], "nn_id": [], "nn_vid": []})

    return run


FOUND = "vid long, dist double, nn_id long, nn_vid long"


def _met(queries: DataFrame, index: DataFrame, k: int, metric: str) -> DataFrame:
    """Results of the queries ``(vid, vec, bound, cell, chunk)`` in the chunks that they name.

    The queries of a chunk are cut into blocks, and the chunk is sent to each of them.
    """
    queries = written(queries, "knn-queries")
    sizes = queries.groupBy("cell", "chunk").agg(F.ceil(F.count("*") / CHUNK).alias("blocks"))
    dealt = queries.join(sizes, ["cell", "chunk"]).withColumn("block", F.pmod(F.xxhash64("vid"), "blocks")).drop("blocks")
    sent = index.join(sizes, ["cell", "chunk"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    by = ["cell", "chunk", "block"]
    return dealt.groupBy(*by).cogroup(sent.drop("blocks", "away").groupBy(*by)).applyInPandas(_search(k, metric), FOUND)


def _nearest(queries: DataFrame, index: DataFrame, k: int, metric: str) -> DataFrame:
    """``(vid, dist, nn_id, nn_vid, rank)``: the ``k`` nearest keys of the classes ``index`` for each class of ``queries``."""
    spark = index.sparkSession
    n = index.count()
    # pivots: a sample by hash of at most PIVOTS vectors
    picked = index.orderBy(F.xxhash64("vid"), "vid").limit(min(PIVOTS, max(1, math.isqrt(n)))).select("vec").collect()
    if not picked:
        return spark.createDataFrame([], FOUND + ", rank int")
    cells = Cells(np.array([r["vec"] for r in picked], dtype=np.float64), metric)
    placed = written(_celled(index, cells), "knn-cells")
    cells.fill(placed.groupBy("cell").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n")).collect())
    counts = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cells.chunks)], "cell int, chunks long")
    placed = placed.join(F.broadcast(counts), "cell").withColumn("chunk", F.pmod(F.xxhash64("vid"), "chunks")).drop("chunks")

    own = _celled(queries.select("vid", "vec"), cells).join(F.broadcast(counts), "cell")
    own = own.select("vid", "vec", F.lit(math.inf).alias("bound"), "cell", F.pmod(F.xxhash64("vid"), "chunks").alias("chunk"))
    own = written(own, "knn-own")
    first = written(_met(own, placed, k, metric), "knn-first")
    kth = first.groupBy("vid").agg(F.count("*").alias("n"), F.max("dist").alias("far")).where(F.col("n") >= k).select("vid", "far")
    bounded = own.drop("bound").join(kth, "vid", "left").withColumn("bound", F.coalesce("far", F.lit(math.inf))).drop("far")
    held = spark.sparkContext.broadcast(cells)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        cell_of = np.repeat(np.arange(len(c.chunks)), c.chunks)
        chunk_of = np.arange(len(cell_of)) - np.repeat(np.cumsum(c.chunks) - c.chunks, c.chunks)
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                bound = part["bound"].to_numpy()
                open_ = c.reachable(_distances(_matrix(part["vec"]), c.pivots, c.metric), bound)[:, cell_of]
                open_ &= ~((cell_of == part["cell"].to_numpy()[:, None]) & (chunk_of == part["chunk"].to_numpy()[:, None]))
                row, to = np.nonzero(open_)
                for i in range(0, len(row), 4096):
                    r, t = row[i : i + 4096], to[i : i + 4096]
                    yield pd.DataFrame({
                        "vid": part["vid"].to_numpy()[r], "vec": part["vec"].to_numpy()[r], "bound": bound[r],
                        "cell": cell_of[t].astype("int32"), "chunk": chunk_of[t],
                    })

    sent = bounded.select("vid", "vec", "bound", "cell", "chunk").mapInPandas(
        spread, "vid long, vec array<double>, bound double, cell int, chunk long"
    )
    every = first.union(_met(sent, placed, k, metric))
    rank = F.row_number().over(Window.partitionBy("vid").orderBy("dist", "nn_id"))
    return written(every.withColumn("rank", rank).where(F.col("rank") <= k), "knn-found")


def nearest(
    queries: DataFrame, key: str, vector: str, index: DataFrame, index_key: str, k: int, metric: str = "minkowski"
) -> DataFrame:
    """``key, rank, nn_id, dist``: the k nearest rows of ``index`` for every row of ``queries``, exactly.

    Vectors of both are in ``vector``; rows without one are left out. Equal distances go to the smaller key. Fewer than k rows
    in ``index`` give all of them; no rows give none.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    sought = written(_classes(queries, key, vector, 1).select("vid", "vec"), "knn-sought")
    found = _nearest(sought, written(_classes(index, index_key, vector, k), "knn-index"), k, metric)
    return _named(queries, key, vector, sought).join(found, "vid").select(
        F.col("key").alias(key), F.col("rank").cast("int").alias("rank"), "nn_id", "dist"
    )


def _named(rows: DataFrame, key: str, vector: str, classes: DataFrame) -> DataFrame:
    """``(key, vid)``: the class of each row."""
    named = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    return named.join(classes.select("vid", "vec"), "vec").select("key", "vid")


def nearest_within(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k nearest other rows of every row: ``key, rank, nn_id, nn_vec, dist``. ``key`` is unique.

    The search is for k + 1 rows; one of them is the row itself, or as many others as near precede it.
    """
    classes = written(_classes(rows, key, vector, k + 1), "knn-index")
    found = _nearest(classes, classes, k + 1, "minkowski")
    others = found.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("rank", "nn_id", "nn_vid", "dist"))).alias("near"))
    mine = F.expr(f"slice(filter(near, x -> x.nn_id <> key), 1, {int(k)})")
    out = _named(rows, key, vector, classes).join(others, "vid").select("key", F.posexplode(mine).alias("at", "n"))
    vectors = classes.select(F.col("vid").alias("nn_vid"), F.col("vec").alias("nn_vec"))
    return out.select("key", (F.col("at") + 1).alias("rank"), "n.nn_id", "n.nn_vid", "n.dist").join(vectors, "nn_vid").select(
        F.col("key").alias(key), "rank", "nn_id", "nn_vec", "dist"
    )


def vote(
    rows: DataFrame, key: str, vector: str, sample: DataFrame, label: str,
    ks: Sequence[int] = range(1, 10), metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """Majority label among the k nearest sample rows, for every metric and k: ``key, metric, k, pred``.

    Equal distances go to the smaller key, equal votes to the smaller label.
    """
    ks = list(ks)
    labels = sample.select(F.col(key).cast("long").alias("nn_id"), F.col(label).cast("long").alias("label"))
    labels = written(labels, "knn-labels")
    out = None
    for metric in metrics:
        near = nearest(rows, key, vector, sample, key, max(ks), metric).join(labels, "nn_id")
        wide = near.select(key, "label", F.explode(F.filter(F.array(*[F.lit(x) for x in ks]), lambda x: x >= F.col("rank"))).alias("k"))
        votes = wide.groupBy(key, "k", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy(key, "k").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("pred"))
        best = best.select(F.col(key).cast("long").alias(key), F.lit(metric).alias("metric"), F.col("k").cast("int").alias("k"), "pred")
        out = best if out is None else out.unionByName(best)
    return out

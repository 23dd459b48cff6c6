"""Seeded sampling by row hash; every draw is reproducible whatever the partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from . import knn
from .ordered import row_index

_LEVELS = ((36, 16), (20, 16), (0, 20))  # (shift, bits) of the 52-bit draw, coarse to fine


def sample_n(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest draws, exactly n whatever their number (all rows of a smaller table).

    Everything below the n-th draw is kept by a filter. Rows that share the n-th draw, so mostly those of equal keys, are
    chosen by a second draw over all columns; what is tied even there is the same row, and any of them will do.
    """
    if n <= 0:
        return df.limit(0)
    if df.count() <= n:
        return df
    below, tied, left = _split_at(df, keys, n, seed)
    sure, same, left = _split_at(tied, df.columns, left, seed)
    return below.union(sure).union(same.limit(left))


def _split_at(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows below the n-th draw, rows of that draw, and how many of the latter are wanted."""
    draw, limit = hashing.hash_int(keys, seed), kth_draw(df, keys, n, seed)
    below = df.filter(draw < limit)
    return below, df.filter(draw == limit), n - below.count()


def kth_draw(df: DataFrame, keys: Sequence[str], k: int, seed: int) -> int:
    """The k-th smallest draw of the table, from three histograms of at most a million cells.

    Each histogram is a partial aggregation over one narrow column; one row reaches the driver.
    """
    draws = df.select(hashing.hash_int(keys, seed).alias("_d"))
    prefix, left = 0, k
    for shift, bits in _LEVELS:
        cell = F.shiftright("_d", shift)
        hist = draws.filter(F.shiftright("_d", shift + bits) == prefix).groupBy(cell.alias("c")).agg(
            F.count(F.lit(1)).alias("n")
        )
        cum = row_sums(hist)
        hit = cum.filter(F.col("upto") >= left).orderBy("c").first()
        prefix, left = hit["c"], left - (hit["upto"] - hit["n"])
    return prefix


def row_sums(hist: DataFrame) -> DataFrame:
    """Running count over a histogram's cells (a bounded number of rows), coarse blocks first."""
    from pyspark.sql import Window

    blocks = hist.groupBy(F.shiftright("c", 8).alias("b")).agg(F.sum("n").alias("bn"))
    before = F.sum("bn").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("b", F.coalesce(before, F.lit(0)).alias("off"))
    inside = F.sum("n").over(Window.partitionBy("b").orderBy("c").rowsBetween(Window.unboundedPreceding, 0))
    return hist.withColumn("b", F.shiftright("c", 8)).join(offsets, "b").select("c", "n", (F.col("off") + inside).alias("upto"))


def split_random(df: DataFrame, keys: Sequence[str], test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Add ``split`` with exactly ceil(share * n) test rows; rows with equal keys stay together."""
    n = df.count()
    if n == 0:
        return df.withColumn("split", F.lit("train"))
    limit = kth_draw(df, keys, max(1, math.ceil(n * test_share)), seed)
    side = F.when(hashing.hash_int(keys, seed) <= limit, F.lit("test")).otherwise(F.lit("train"))
    return df.withColumn("split", side)


def draw_with_replacement(rows: DataFrame, keys: Sequence[str], n: int, extra: int, seed: int) -> DataFrame:
    """``extra`` rows drawn with replacement from the n given ones, with their draw number ``_draw``."""
    indexed = row_index(rows.withColumn("_h", hashing.row_hash(keys, seed)), ["_h", *keys], "_idx").drop("_h")
    draws = rows.sparkSession.range(extra).select(
        F.col("id").alias("_draw"), (hashing.hash_int(["id"], seed) % n + 1).alias("_idx")
    )
    return draws.join(indexed, "_idx").drop("_idx")


def replicate(df: DataFrame, mask: Column, multiplier: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Add int(n * (multiplier - 1)) copies of matching rows, drawn with replacement."""
    rows = df.filter(mask)
    n = rows.count()
    extra = int(n * max(0.0, multiplier - 1.0))
    if extra == 0:
        return df
    return df.unionByName(draw_with_replacement(rows, keys, n, extra, seed).drop("_draw"))


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class; classes are few."""
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}


def oversample(df: DataFrame, label: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Copy rows of the smaller classes until all classes have the largest one's size."""
    counts = class_counts(df, label)
    most = max(counts.values())
    out = df
    for value, n in sorted(counts.items()):
        if n < most:
            rows = df.filter(F.col(label) == value)
            out = out.unionByName(draw_with_replacement(rows, keys, n, most - n, seed).drop("_draw"))
    return out


def smote(df: DataFrame, vector: str, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows for the smaller classes, between a row and one of its k nearest of the same class.

    Output: label, draw number, base and neighbour keys, and the new vector.
    """
    counts = class_counts(df, label)
    most = max(counts.values())
    out = None
    for value, n in sorted(counts.items()):
        if n == most or n < 2:
            continue
        rows = df.filter(F.col(label) == value).select(F.col(key).alias("base"), F.col(vector).alias("x"))
        near = knn.nearest_within(rows, "base", "x", min(k, n - 1))
        drawn = draw_with_replacement(rows, ["base"], n, most - n, seed)
        pick = hashing.hash_int(["_draw"], seed + 1) % min(k, n - 1) + 1
        u = hashing.hash_unit(["_draw"], seed + 2)
        moved = F.zip_with("x", "nn_vec", lambda a, b: a + F.col("_u") * (b - a))
        new = (
            drawn.withColumns({"rank": pick.cast("int"), "_u": u}).join(near, ["base", "rank"])
            .select(F.lit(value).alias(label), F.col("_draw").alias("draw"), "base", "nn_id", moved.alias(vector))
        )
        out = new if out is None else out.unionByName(new)
    return out

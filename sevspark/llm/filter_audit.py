"""Audit of how text filters interact: what each removes in every order, and its exact Shapley share.

Every document is reduced to the set of filters that it fails, every part of the corpus to at most 32 counts. From these
``coalitions`` tabulates what each set of filters removes together; differences between two sets are what a filter removes at a
step, and ``shapley`` solves the kernel-weighted least squares problem with the efficiency constraint in rationals.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LAST_ID

FILTERS = "ABCDE"
WORD = r"([^\x20\x09-\x0D]+)"
#: What is counted of each set of failed filters.
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; null counts as the empty text.

    A: under 200 words. B: fewer than half of the words are distinct. C: over 3 % of the code points are A-Z.
    D: holds any of ``# $ % & * |``. No words: A alone of the first two; no code points: not C.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(1))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals > 3 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each part by the set of filters that they fail.

    E, a text identical to that of a smaller id, needs no join of the copies to their first: rows are summed by text and part
    first, and what has the text's least id is told apart from the rest by a window over these sums, one for each part.
    A null id orders after all others and has no labels. A label that occurs several times for an id counts once, as 1 if any is.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(0x9E3779B9), text).alias("h2"),
        failures(text).alias("mask"),
    )
    # rows without an id meet no label: they are spread by their text
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("h1")).otherwise(F.lit(0)))
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = rows.join(marks.withColumn("spread", F.lit(0).cast("bigint")), ["doc_id", "spread"], "left")
    ids = rows.groupBy("h1", "h2", "part", "mask", F.coalesce("doc_id", F.lit(LAST_ID)).alias("ord")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    parts = ids.groupBy("h1", "h2", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.min(F.struct("ord", *COUNTS)).alias("first")
    )
    least = F.min("first.ord").over(Window.partitionBy("h1", "h2"))
    parts = parts.withColumn("leads", F.col("first.ord") == least)
    early = [F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(0).alias(c) for c in COUNTS]
    late = [(F.col(c) - F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(0)).alias(c) for c in COUNTS]
    sides = F.array(
        F.struct(F.col("mask").alias("mask"), *early), F.struct((F.col("mask") + F.lit(1 << 4)).alias("mask"), *late)
    )
    sums = parts.select("part", F.explode(sides).alias("side")).select("part", "side.*")
    return sums.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


def coalitions(counts: dict[int, int], filters: int = len(FILTERS)) -> list[int]:
    """What each set of filters removes together, by the set's bits."""
    return [sum(n for mask, n in counts.items() if mask & together) for together in range(1 << filters)]


def solve(rows: list[list[Fraction]]) -> list[Fraction]:
    """Solution of a square system of equations, each row with its right side, by elimination in rationals."""
    rows = [list(r) for r in rows]
    for i in range(len(rows)):
        pivot = next(j for j in range(i, len(rows)) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j, row in enumerate(rows):
            if j != i and row[i]:
                rows[j] = [x - row[i] * y for x, y in zip(row, rows[i])]
    return [r[-1] for r in rows]


def shapley(removed: list[int]) -> list[Fraction]:
    """Shapley value of each filter, from what each of the 2**k sets of k filters removes.

    The weighted squares of ``removed[S] - sum of the values in S`` are least over all values that sum to what all filters
    remove; the weight of a set of size s is (k - 1) / (C(k, s) s (k - s)).
    """
    k = (len(removed) - 1).bit_length()
    if k == 1:
        return [Fraction(removed[1] - removed[0])]
    normal = [[Fraction(0)] * (k + 2) for _ in range(k + 1)]
    for together in range(1, len(removed) - 1):
        inside = [i for i in range(k) if together >> i & 1]
        weight = Fraction(k - 1, comb(k, len(inside)) * len(inside) * (k - len(inside)))
        for i in inside:
            for j in inside:
                normal[i][j] += weight
            normal[i][-1] += weight * (removed[together] - removed[0])
    for i in range(k):
        normal[i][k] = normal[k][i] = Fraction(1)  # the multiplier of the constraint
    normal[k][-1] = Fraction(removed[-1] - removed[0])
    return solve(normal)[:k]


def steps(counts: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part from its rows ``(part, mask, n, good, toxic)``."""
    tables = {c: coalitions(dict(zip(counts["mask"], counts[c].astype(int)))) for c in COUNTS}
    removed, total = tables["n"], int(counts["n"].sum())
    k = len(FILTERS)
    orders = list(permutations(range(k)))
    shares = [x * len(orders) for x in shapley(removed)]
    if any(x.denominator != 1 for x in shares):
        raise ArithmeticError("a Shapley sum is not a whole number")
    rows = []
    for order in orders:
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = {c: t[after] - t[before] for c, t in tables.items()}
            rows.append((
                counts["part"].iloc[0], "".join(FILTERS[j] for j in order), step, total - removed[after], here["n"],
                removed[1 << i] - here["n"], removed[-1] - removed[-1 - (1 << i)], here["good"], here["toxic"], int(shares[i]),
            ))
            before = after
    return pd.DataFrame(rows, columns=NAMES)


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in NAMES[3:])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (language; null: empty), order of the five filters and step; an empty table gives no rows.

    ``kept`` after the step, ``removed`` at it, ``redundant`` (failed, but removed earlier), ``unique_fails`` (nothing else
    fails), ``good_lost`` and ``toxic_lost`` (labelled ones removed at it), ``shapley`` (the filter's removals summed over all
    orders). Rows that share an id or a text each count; other columns are not read. A task sees at most 32 rows of a part.
    """
    return failed_sets(docs, labels).groupBy("part").applyInPandas(steps, SCHEMA)

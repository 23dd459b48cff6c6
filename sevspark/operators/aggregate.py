"""Aggregations. All use partial aggregation before the shuffle, so a hot key stays small."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), dtype: str = "double") -> DataFrame:
    """Rows ``(keys..., feature, value)``; all features in one pass over the table."""
    typed = df.select(*keys, *[F.col(c).cast(dtype).alias(c) for c in columns])
    return typed.unpivot(list(keys), list(columns), "feature", "value")


def count_per_key(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def rate_per_group(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Row count and mean label per group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"))


def having(groups: DataFrame, min_rate: float, min_count: int) -> DataFrame:
    return groups.filter((F.col("rate") >= min_rate) & (F.col("n") >= min_count))


def value_counts(df: DataFrame, columns: Sequence[str], dtype: str = "double") -> DataFrame:
    """``(feature, value, n)`` for many columns with one shuffle; NULLs are not counted."""
    return melt(df, columns, dtype=dtype).dropna(subset=["value"]).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def modes(df: DataFrame, columns: Sequence[str], dtype: str = "double") -> DataFrame:
    """Most frequent value per column; the smallest one on ties, NULLs ignored.

    Counts are spread over (feature, value) groups, so no task ever holds a column's whole
    dictionary the way a single ``mode`` buffer would.
    """
    best = F.min_by("value", F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v")))
    return value_counts(df, columns, dtype).groupBy("feature").agg(best.alias("value"))


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Contingency table with one count column per given value."""
    cells = [
        F.count_if(F.col(columns).eqNullSafe(F.lit(v))).alias(f"{columns}_{v}") for v in values
    ]
    return df.groupBy(rows).agg(*cells)


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Count of each value and its share of the rows with a known value."""
    counts = df.dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", (F.col("n") / total).alias("share"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values of several columns, one row per (feature, value)."""
    return value_counts(df, columns, dtype="string").select("feature", "value")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, from one aggregate."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs],
        *[F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs],
        *[F.struct(F.lit(a).alias("a"), F.lit(a).alias("b"), F.lit(1.0).alias("r")) for a in columns],
    )
    return row.select(F.inline(cells))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """'balanced' weights n / (k * n_c) per class."""
    counts = class_balance(df, label)
    scale = counts.agg(F.sum("n") / F.count(F.lit(1))).scalar()
    return counts.select(label, "n", (scale / F.col("n")).alias("weight"))


def share_positive(df: DataFrame, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Percentage of rows predicted positive."""
    return df.groupBy(*keys).agg((F.avg(F.col(prediction).cast("double")) * 100).alias("pct"))


def conditional_count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))

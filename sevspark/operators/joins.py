"""Joins. Strategy is left to the optimizer and to adaptive execution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def inner(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")


def left_outer(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Left join; ``null_safe`` also matches NULL keys with each other."""
    if not null_safe:
        return left.join(right, list(keys), "left")
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(renamed, match, "left").drop(*[f"__{k}" for k in keys])


def with_counts(df: DataFrame, source: DataFrame, key: str, name: str) -> DataFrame:
    """Add the number of ``source`` rows per key; keys without rows are dropped."""
    counts = source.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, key, "inner")


def align_labels(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Attach labels by row key (files aligned by position need a key column first)."""
    return features.join(labels, key, "inner")


def versions_with_runs(versions: DataFrame, runs: DataFrame, experiment: str) -> DataFrame:
    """Model versions with their run, for one experiment."""
    return versions.join(runs.filter(F.col("experiment") == experiment), "run_id", "inner")


def opened_not_closed(lines: DataFrame, key: str, event: str, opened: str, closed: str) -> DataFrame:
    """Keys with an ``opened`` event and no ``closed`` one."""
    is_open = lines.filter(F.col(event) == opened).select(key).distinct()
    is_closed = lines.filter(F.col(event) == closed).select(key).distinct()
    return is_open.join(is_closed, key, "left_anti")


def contains_keyword(df: DataFrame, column: str, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per (row, category) whose text holds one of the category's keywords.

    The keyword table is an argument of a handful of entries, so it is evaluated as an expression
    in the scan's own stage: no join and no broadcast.
    """
    low = F.lower(F.col(column))
    hits = []
    for category, words in keywords.items():
        found: Column = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w.lower()))
        hits.append(F.when(found, F.lit(category)))
    return df.withColumn("category", F.explode(F.array_compact(F.array(*hits))))


def fuzzy_to_names(df: DataFrame, column: str, names: Sequence[str], threshold: float) -> DataFrame:
    """One row per (row, name) with a block-matching ratio at or over the threshold.

    ``names`` is a short argument list (category names), evaluated in the scan's stage. Blocks are looked for only where the
    lengths alone allow the threshold: matched characters are at most those of the shorter text.
    """
    stem = text.strip_trailing_number(F.col(column))
    scored = []
    for n in names:
        short, both = F.least(F.length(stem), F.lit(len(n))), F.length(stem) + len(n)
        score = F.when(2 * short >= threshold * both, text.block_ratio(F.lit(n), stem))
        scored.append(F.struct(F.lit(n).alias("name"), score.alias("score")))
    kept = F.filter(F.array(*scored), lambda s: s["score"] >= threshold)
    return df.withColumn("_m", F.explode(kept)).select(*df.columns, "_m.name", "_m.score")

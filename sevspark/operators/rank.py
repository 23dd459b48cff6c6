"""Per-group picks, top-k and set operations.

Ranks are always filtered to ``<= k``, which Spark turns into a partial top-k before the shuffle
(WindowGroupLimit), so a hot group ships k rows per task rather than all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_max(df: DataFrame, key: str | Sequence[str], severity: str, ties: Sequence[str] = ()) -> DataFrame:
    """One row per key: highest severity, ties broken by the other columns, all descending.

    The maximum is taken before and after the shuffle, so a hot key ships one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in {*keys, severity, *ties}]
    row = F.struct(severity, *ties, *rest)
    return df.groupBy(*keys).agg(F.max(row).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def top_groups(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Global top n: each task keeps n rows, no full sort."""
    return df.orderBy(*order).limit(n)


def shortest(df: DataFrame, group: str, text: str, columns: Sequence[str]) -> DataFrame:
    """Row with the shortest text per group; the smaller text wins ties."""
    best = F.min_by(
        F.struct(*columns), F.struct(F.length(text).alias("_len"), F.col(text).alias("_text"))
    )
    return df.groupBy(group).agg(best.alias("_r")).select(group, "_r.*")


def first_in_order(df: DataFrame, group: str, order: str, columns: Sequence[str]) -> DataFrame:
    """First row per group in the given order."""
    return df.groupBy(group).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_r")).select(group, "_r.*")


def latest(df: DataFrame, group: str, ts: str, columns: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """Newest row per group."""
    order = F.struct(F.col(ts).alias("_ts"), *[F.col(c).alias(f"_{c}") for c in ties])
    return df.groupBy(group).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(group, "_r.*")


def keep_newest(
    runs: DataFrame, family: str, ts: str, run_id: str, keep: int, protected: DataFrame
) -> DataFrame:
    """Runs beyond the newest ``keep`` of their family, except protected ones.

    The newest rows are found with a partial top-k; everything that is not among them and not
    protected is expired. No task sorts a whole family.
    """
    newest = Window.partitionBy(family).orderBy(F.col(ts).desc(), F.col(run_id).desc())
    kept = (
        runs.select(family, ts, run_id).withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= keep).select(run_id)
    )
    return runs.join(kept.unionByName(protected.select(run_id)), run_id, "left_anti")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of every group with their rank."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def tail_with_hidden(
    lines: DataFrame, group: str, order: Sequence[str], level: str, message: str,
    noise: Sequence[str], n: int, min_level: int = 20,
) -> DataFrame:
    """Last n useful lines per group, in order, plus how many earlier ones are hidden."""
    useful = lines.filter((F.col(level) >= min_level) & (F.trim(message) != ""))
    for pattern in noise:
        useful = useful.filter(~F.contains(F.col(message), F.lit(pattern)))
    totals = useful.groupBy(group).agg(F.count(F.lit(1)).alias("_total"))
    last = top_per_group(useful, [group], [F.col(c).desc() for c in order], n)
    hidden = F.greatest(F.col("_total") - n, F.lit(0))
    return last.join(totals, group).withColumn("hidden", hidden).drop("_total")


def missing_from(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``expected`` that are not in ``found``."""
    return expected.exceptAll(found)


def dedup_on_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the largest by the order columns, then by the rest."""
    return pick_max(df, key, order[0], list(order[1:]))


def scores_desc(scores: DataFrame, score: str, name: str) -> DataFrame:
    """A report's scores from high to low with their place; one row per monitored feature."""
    row = F.struct((-F.col(score)).alias("neg"), F.col(name).alias("name"), F.struct("*").alias("row"))
    ordered = scores.agg(F.array_sort(F.collect_list(row)).alias("_a"))
    return ordered.select(F.posexplode("_a").alias("_p", "_r")).select("_r.row.*", (F.col("_p") + 1).alias("place"))

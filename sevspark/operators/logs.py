"""Log-line operators; each works on a batch and on a stream alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import logfmt


def parse(df: DataFrame, line: str, target: str = "fields") -> DataFrame:
    return df.withColumn(target, logfmt.parse_pairs(F.col(line)))


def with_level_and_run(df: DataFrame, line: str) -> DataFrame:
    return df.withColumns({"level": logfmt.level(F.col(line)), "run": logfmt.run_id(F.col(line))})


def window_of(ts: str, width: str, slide: str | None = None) -> Column:
    return F.window(ts, width, slide) if slide else F.window(ts, width)


def count_in_windows(
    df: DataFrame, ts: str, keys: Sequence[str], width: str, slide: str | None = None
) -> DataFrame:
    """Rows per key and (tumbling or sliding) window."""
    counted = df.groupBy(window_of(ts, width, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).rlike(pattern))

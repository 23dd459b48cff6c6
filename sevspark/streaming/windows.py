"""Windowed, session and de-duplicated streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import logs, metrics


def tumbling_counts(stream: DataFrame, ts: str, keys: Sequence[str], width: str, late: str) -> DataFrame:
    return logs.count_in_windows(stream.withWatermark(ts, late), ts, keys, width)


def sliding_rate(stream: DataFrame, ts: str, keys: Sequence[str], width_s: int, slide_s: int, late: str) -> DataFrame:
    return metrics.rate(stream.withWatermark(ts, late), ts, keys, width_s, slide_s)


def sessions(stream: DataFrame, ts: str, keys: Sequence[str], gap: str, late: str) -> DataFrame:
    """Periods of activity per key, closed by a gap."""
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys)
    counted = grouped.agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(stream: DataFrame, ts: str, keys: Sequence[str], late: str) -> DataFrame:
    """Each key once, for sources that deliver at least once; state is dropped behind the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))

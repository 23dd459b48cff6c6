"""Pairing of start and end events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered


def pair_start_end(
    df: DataFrame, series: Sequence[str], ts: str, order: Sequence[str], event: str, start: str, end: str
) -> DataFrame:
    """Each end with the start right before it in its series, and the seconds between them.

    Only start and end rows are ordered; an end without an open start is left out.
    """
    marks = df.filter(F.col(event).isin(start, end))
    paired = Ordered(marks, series, order).previous({"_e": event, "start": ts}).rows()
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    return paired.filter((F.col(event) == end) & (F.col("_e") == start)).select(
        *series, "start", F.col(ts).alias("end"), (seconds / 1e6).alias("duration_s")
    )

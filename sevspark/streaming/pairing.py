"""Start and end events of the same piece of work, from two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_start_end(starts: DataFrame, ends: DataFrame, key: str, ts: str, within: str, late: str) -> DataFrame:
    """Ends at most ``within`` after their start; both sides' state ends with that bound."""
    a = starts.withWatermark(ts, late).select(F.col(key).alias("start_key"), F.col(ts).alias("start"))
    b = ends.withWatermark(ts, late).select(F.col(key).alias("end_key"), F.col(ts).alias("end"))
    bound = (F.col("end") >= F.col("start")) & (F.col("end") <= F.col("start") + F.expr(f"INTERVAL {within}"))
    joined = a.join(b, (F.col("start_key") == F.col("end_key")) & bound, "inner")
    seconds = (F.unix_micros("end") - F.unix_micros("start")) / 1e6
    return joined.select(F.col("start_key").alias(key), "start", "end", seconds.alias("duration_s"))

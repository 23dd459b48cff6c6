"""Request, probe and counter metrics; aggregations work on batches and streams alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from .logs import window_of
from .ordered import Ordered, islands


def requests_total(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def rate(df: DataFrame, ts: str, keys: Sequence[str], width_s: int, slide_s: int | None = None) -> DataFrame:
    """Requests per second in each window."""
    w = window_of(ts, f"{width_s} seconds", f"{slide_s} seconds" if slide_s else None)
    counted = df.groupBy(w.alias("w"), *keys).agg((F.count(F.lit(1)) / F.lit(float(width_s))).alias("rate"))
    return counted.select(F.col("w.start").alias("start"), *keys, "rate")


def status_class(status: Column) -> Column:
    return F.concat(F.substring(status, 1, 1), F.lit("xx"))


def error_ratio(df: DataFrame, status: str, ts: str | None = None, width: str = "5 minutes", keys: Sequence[str] = ()):
    """Share of 5xx answers in percent, 0 when there are no requests."""
    grouping = [window_of(ts, width).alias("w")] if ts else []
    ratio = F.try_divide(F.count_if(F.col(status).startswith("5")), F.count(F.lit(1))) * 100
    out = df.groupBy(*grouping, *keys).agg(F.coalesce(ratio, F.lit(0.0)).alias("error_pct"))
    return out.select(F.col("w.start").alias("start"), *keys, "error_pct") if ts else out


def histogram(df: DataFrame, value: str, keys: Sequence[str], bounds: Sequence[float] = presets.LATENCY_BUCKETS):
    """Cumulative bucket counts as one row per group: ``buckets array<struct<le, n>>`` and ``total``.

    The last bucket (``le`` NULL) has no upper bound.
    """
    counts = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("total"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("total").alias("n")))
    return wide.select(*keys, F.array(*cells).alias("buckets"), "total")


def bucket_rows(histograms: DataFrame, keys: Sequence[str]) -> DataFrame:
    return histograms.select(*keys, F.inline("buckets"))


def bucket_quantile(buckets: Column, total: Column, q: float) -> Column:
    """Quantile by linear interpolation inside the first bucket that reaches the rank.

    Ranks beyond the last bound give that bound.
    """
    want = total * F.lit(q)
    reached = F.filter(buckets, lambda b: b["n"] >= want)[0]
    before = F.filter(buckets, lambda b: b["n"] < want)
    prev_n = F.when(F.size(before) > 0, F.element_at(before, -1)["n"]).otherwise(F.lit(0))
    prev_le = F.when(F.size(before) > 0, F.element_at(before, -1)["le"]).otherwise(F.lit(0.0))
    inside = prev_le + (reached["le"] - prev_le) * F.try_divide(want - prev_n, reached["n"] - prev_n)
    return F.when(total == 0, F.lit(None)).when(reached["le"].isNull(), prev_le).otherwise(inside)


def latency_quantiles(histograms: DataFrame, keys: Sequence[str], qs: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    return histograms.select(
        *keys, *[bucket_quantile(F.col("buckets"), F.col("total"), q).alias(f"p{round(q * 100)}") for q in qs]
    )


def prediction_mix(df: DataFrame, ts: str, prediction: str, width_s: int) -> DataFrame:
    """Per window: predictions, severe ones, their share in percent and the rate per second."""
    severe = F.count_if(F.col(prediction) == 1)
    out = df.groupBy(window_of(ts, f"{width_s} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), severe.alias("severe"),
        (severe * 100 / F.count(F.lit(1))).alias("severe_pct"),
        (F.count(F.lit(1)) / F.lit(float(width_s))).alias("rate"),
    )
    return out.select(F.col("w.start").alias("start"), "n", "severe", "severe_pct", "rate")


def counter_increase(df: DataFrame, series: str, order: Sequence[str], value: str) -> DataFrame:
    """Growth of each counter; a falling value is a reset, after which counting restarts at 0."""
    steps = Ordered(df, [series], order).previous({"_before": value}).rows()
    grown = F.when(F.col("_before").isNull(), F.lit(0.0)).when(
        F.col(value) < F.col("_before"), F.col(value)
    ).otherwise(F.col(value) - F.col("_before"))
    return steps.groupBy(series).agg(
        F.sum(grown).alias("increase"), F.count_if(F.col(value) < F.col("_before")).alias("resets")
    )


def last_period(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the newest row."""
    newest = df.agg(F.max(ts)).scalar()
    return df.filter(F.col(ts) > newest - F.expr(f"INTERVAL {days} DAYS"))


def availability(df: DataFrame, keys: Sequence[str], up: str, period_s: float = 604_800) -> DataFrame:
    """Percentage of good probes and the seconds of downtime it stands for."""
    return df.groupBy(*keys).agg(
        (F.avg(up) * 100).alias("availability"), ((1 - F.avg(up)) * F.lit(float(period_s))).alias("downtime_s")
    )


def interruptions(df: DataFrame, series: str, order: Sequence[str], up: str) -> DataFrame:
    """Interruptions per series: half its state changes, rounded up."""
    steps = Ordered(df, [series], order).previous({"_before": up}).rows()
    changes = F.count_if(F.col("_before") != F.col(up))
    return steps.groupBy(series).agg(
        changes.alias("changes"), F.ceil(changes / 2).cast("bigint").alias("interruptions")
    )


def state_timeline(df: DataFrame, series: str, ts: str, order: Sequence[str], state: str) -> DataFrame:
    """Runs of equal state per series with first and last time and sample count."""
    numbered = islands(df, [series], order, state)
    return numbered.groupBy(series, "island", state).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("samples")
    )


def free_pct(df: DataFrame, available: str, size: str) -> DataFrame:
    return df.withColumn("free_pct", F.try_divide(F.col(available), F.col(size)) * 100)

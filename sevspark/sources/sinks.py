"""Writers: split tables, the predictions log, drift reports and table fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import when
from .tables import exists, remove


def write_splits(df: DataFrame, path: str, year: str = "year_acc") -> None:
    """Features and labels together, one folder per split and year (row order plays no part)."""
    df.write.mode("overwrite").partitionBy("split", year).parquet(path)


def stamp_predictions(scored: DataFrame, version: str, year_month: str | None = None) -> DataFrame:
    """Add model version, probability to 4 decimals and the time (or mid-month of a given month)."""
    at = when.mid_month(F.lit(year_month)) if year_month else F.current_timestamp()
    return scored.withColumns(
        {"model_version": F.lit(version), "probability": F.round("probability", 4), "created_at": at}
    )


def append_predictions(df: DataFrame, path: str, batch_id: int, writer: str) -> None:
    """Write one batch to the folder of its writer (a job run or a stream) and number.

    A batch that the same writer repeats replaces itself instead of doubling; another writer never touches it.
    """
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/writer={writer}/batch_id={batch_id}")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_drift_reports(summaries: DataFrame, folder: str) -> None:
    """All yearly summaries as JSON, plus the newest one under ``latest``, taken from what was written."""
    summaries.write.mode("overwrite").partitionBy("year").json(f"{folder}/reports")
    kept = summaries.sparkSession.read.schema(summaries.schema).json(f"{folder}/reports")
    latest = kept.filter(F.col("year") == kept.agg(F.max("year")).scalar())
    latest.write.mode("overwrite").json(f"{folder}/latest")


def reset(spark: SparkSession, path: str) -> int:
    """Empty a parquet table, keep its columns, return how many rows went."""
    if not exists(spark, path):
        return 0
    df = spark.read.parquet(path)
    removed = df.count()
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
    return removed


def reset_drift_reports(spark: SparkSession, folder: str) -> bool:
    """Delete the yearly and the latest reports of ``write_drift_reports``; tell whether any were there."""
    parts = [p for p in (f"{folder}/reports", f"{folder}/latest") if exists(spark, p)]
    for p in parts:
        remove(spark, p)
    return bool(parts)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free identity of a table: row count, xor and sum of row hashes.

    Equal rows cancel in the xor, hence the sum beside it.
    """
    h = F.xxhash64(*(columns or df.columns))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("hash_xor"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    )

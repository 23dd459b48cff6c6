"""File listings and year discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import presets

YEAR_FOLDER = r"/(?:[A-Za-z_]+=)?(\d{4})/[^/]+$"


def files(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """``path, length, name, year`` of every file; file contents are not read."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root).select("path", "length")
    )
    return found.select(
        "path", "length", F.element_at(F.split("path", "/"), -1).alias("name"),
        F.regexp_extract("path", YEAR_FOLDER, 1).try_cast("int").alias("year"),
    )


def available_years(
    listing: DataFrame, first_year: int = presets.FIRST_YEAR, min_files: int = 4, last_year: int | None = None
) -> DataFrame:
    """Years whose folder holds enough files."""
    years = listing.filter(F.col("year") >= first_year)
    if last_year is not None:
        years = years.filter(F.col("year") <= last_year)
    return years.groupBy("year").agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") >= min_files).select("year")


def sorted_years(years: DataFrame, at_least: int = 1) -> list[int]:
    """The distinct years in order (a handful); too few are an error."""
    found = sorted(r["year"] for r in years.select("year").distinct().collect())
    if len(found) < at_least:
        raise ValueError(f"at least {at_least} years are needed, found {found}")
    return found


def newest_year(years: DataFrame) -> Column:
    return years.agg(F.max("year")).scalar()


def drift_years(years: DataFrame) -> DataFrame:
    """Each year with its role: the newest is 'current', all earlier ones 'reference'."""
    role = F.when(F.col("year") == newest_year(years), F.lit("current")).otherwise(F.lit("reference"))
    return years.select("year", role.alias("role"))


def years_up_to(years: DataFrame, year: int) -> DataFrame:
    return years.filter(F.col("year") <= year)


def year_label(years: DataFrame) -> DataFrame:
    """'min-max' of the years."""
    text = F.concat_ws("-", F.min("year").cast("string"), F.max("year").cast("string"))
    return years.agg(text.alias("label"))


def year_range(last: DataFrame, first_year: int) -> DataFrame:
    """Every year from the first to the one in ``last`` (column ``year``, one row), present or not."""
    return last.select(F.explode(F.sequence(F.lit(first_year), F.col("year"))).alias("year"))

"""Feature derivation, splits and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import aggregate


def year_of_key(key: Column) -> Column:
    """First four characters of an incident number."""
    return F.substring(key, 1, 4).try_cast("int")


def age(year: Column, birth_year: Column, low: int = 0, high: int = 120) -> Column:
    """Age in the incident's year; NULL outside the plausible range."""
    years = year - birth_year
    return F.when(years.between(low, high), years)


def split_by_newest_year(df: DataFrame, year: str) -> DataFrame:
    """Add ``split``: the newest year is 'test', all earlier ones 'train'."""
    newest = df.agg(F.max(year)).scalar()
    return df.withColumn("split", F.when(F.col(year) == newest, F.lit("test")).otherwise(F.lit("train")))


def train_modes(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """One row ``(modes map<feature, value>)`` over the train rows."""
    found = aggregate.modes(df.filter(F.col(split) == "train"), columns)
    return found.agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("modes"))


def impute_train_modes(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Fill NULLs of both splits with the train modes (one scalar subquery for all columns)."""
    types = dict(df.dtypes)
    modes = train_modes(df, columns, split).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), modes[c].cast(types[c])) for c in columns})

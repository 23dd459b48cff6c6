"""Projections and filters that clean raw tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, when


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def edit(df: DataFrame, edits: Mapping) -> DataFrame:
    """Replace the columns that exist, in one projection."""
    return df.withColumns({c: e for c, e in edits.items() if c in df.columns})


def renames_due(columns: Sequence[str], renames: Mapping[str, str]) -> dict[str, str]:
    """Renames whose old name is present and whose new name is not."""
    return {old: new for old, new in renames.items() if old in columns and new not in columns}


def known_renames(df: DataFrame, renames: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    due = renames_due(df.columns, renames)
    return df.withColumnsRenamed(due), sorted(due)


def clean_strings(df: DataFrame) -> DataFrame:
    """Drop no-break spaces and outer blanks in every text column."""
    return edit(df, {c: text.strip_text(F.col(c)) for c in string_columns(df)})


def decimal_commas(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return edit(df, {c: text.decimal_comma(F.col(c)) for c in columns})


def hours(df: DataFrame, source: str, target: str, strict_hhmm: bool = False) -> DataFrame:
    return df.withColumn(target, text.hour_of(F.col(source), strict_hhmm))


def replace_text(df: DataFrame, columns: Sequence[str], pairs: Mapping[str, str]) -> DataFrame:
    return edit(df, {c: text.replace_all(F.col(c), pairs) for c in columns})


def numeric_or_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return edit(df, {c: text.int_or_zero(F.col(c)) for c in columns})


def recode(df: DataFrame, column: str, mapping: Mapping) -> DataFrame:
    return edit(df, {column: text.recode(F.col(column), mapping)})


def sentinels_to_null(df: DataFrame, sentinels: Mapping[int, Sequence[str]]) -> DataFrame:
    """``{-1: [...], 0: [...]}``: NULL where the column holds the sentinel."""
    edits: dict = {}
    for value, columns in sentinels.items():
        for c in columns:
            edits[c] = F.nullif(edits.get(c, F.col(c)), F.lit(value))
    return edit(df, edits)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_if_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def drop_critical_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=[c for c in columns if c in df.columns])


def fill_missing_columns(df: DataFrame, expected: Sequence[str], value=0) -> DataFrame:
    """Exactly the expected columns, in order; absent ones hold ``value``."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(value).alias(c) for c in expected])


def cast_columns(df: DataFrame, columns: Sequence[str], dtype: str = "double") -> DataFrame:
    return edit(df, {c: F.col(c).cast(dtype) for c in columns})


def with_datetime(df: DataFrame, year: str, month: str, day: str, hhmm: str, target: str) -> DataFrame:
    return df.withColumn(target, when.timestamp_of(F.col(year), F.col(month), F.col(day), F.col(hhmm)))


def letter_codes(df: DataFrame, columns: Sequence[str], letters: Mapping[str, str]) -> DataFrame:
    return edit(df, {c: text.letters_to_int(F.col(c), letters) for c in columns})


def in_month(df: DataFrame, column: str, year_month: str | None) -> DataFrame:
    return df if not year_month else df.filter(F.col(column) == when.month_of(year_month))


def in_list(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is listed; an empty list keeps all."""
    return df.filter(F.col(column).isin(list(values))) if values else df


def any_column_contains(df: DataFrame, needle: str) -> DataFrame:
    """Rows with the text in any column, ignoring case."""
    if not needle:
        return df
    joined = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in df.columns])
    return df.filter(F.contains(F.lower(joined), F.lit(needle.lower())))


def union_years(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate yearly frames; columns missing in one year are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

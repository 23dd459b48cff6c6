"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp_of(year: Column, month: Column, day: Column, hhmm: Column) -> Column:
    """Timestamp from date parts and a 'HH:MM' text; impossible dates give NULL."""
    text = F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"),
        F.lit("-"), F.lpad(day.cast("string"), 2, "0"), F.lit(" "), hhmm,
    )
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm"))


def mid_month(year_month: Column) -> Column:
    """Day 15, 12:00 UTC of a 'YYYY-MM' text."""
    parts = F.split(year_month, "-")
    return F.make_timestamp(
        parts[0].cast("int"), parts[1].cast("int"), F.lit(15), F.lit(12), F.lit(0), F.lit(0), F.lit("UTC")
    )


def month_of(year_month: str) -> int:
    """Month number of a 'YYYY-MM' argument."""
    return int(year_month.split("-")[1])


def local_minute(ts: Column, zone: str) -> Column:
    """UTC timestamp as local 'YYYY-MM-DD HH:MM', with a dash for missing values."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm"), F.lit("—"))


def seconds_text(seconds: Column) -> Column:
    """'12s', or a dash when missing or zero."""
    shown = F.concat(F.bround(seconds, 0).cast("bigint").cast("string"), F.lit("s"))
    return F.when(seconds.isNull() | (seconds == 0), F.lit("—")).otherwise(shown)


def stamp(ts: Column) -> Column:
    """Timestamp as plain text, independent of the session's zone."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")

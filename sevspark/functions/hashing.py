"""Seeded hash draws: the same row gets the same draw under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 2**52


def row_hash(keys: Sequence[str | Column], seed: int) -> Column:
    """Hex digest of the key values and the seed."""
    cols = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *cols, F.lit(str(seed))).cast("binary"))


def hash_int(keys: Sequence[str | Column], seed: int) -> Column:
    """Draw in [0, 2**52) from the first 13 hex digits."""
    return F.conv(F.substring(row_hash(keys, seed), 1, 13), 16, 10).cast("bigint")


def hash_unit(keys: Sequence[str | Column], seed: int) -> Column:
    """Draw in [0, 1)."""
    return hash_int(keys, seed) / F.lit(float(DRAW_RANGE))

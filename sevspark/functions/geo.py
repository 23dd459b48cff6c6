"""Coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_box(lat: Column, lon: Column, lat_bounds: tuple[float, float], lon_bounds: tuple[float, float]) -> Column:
    return lat.between(*lat_bounds) & lon.between(*lon_bounds)


def outside_box(lat: Column, lon: Column, lat_bounds: tuple[float, float], lon_bounds: tuple[float, float]) -> Column:
    """True when either known coordinate is out of bounds; missing values do not count."""
    lat_out = F.coalesce(~lat.between(*lat_bounds), F.lit(False))
    lon_out = F.coalesce(~lon.between(*lon_bounds), F.lit(False))
    return lat_out | lon_out


def grid_cell(x: Column, cells_per_degree: int) -> Column:
    """Nearest grid line, halves to even."""
    return F.rint(x * cells_per_degree) / cells_per_degree
